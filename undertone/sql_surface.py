"""Read-only SQL for agents over a fixed set of views."""

from __future__ import annotations

import re
import uuid

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

# What a read-only statement may not contain, in strings as well.
FORBIDDEN = (
    "insert", "update", "delete", "merge", "create", "drop", "alter", "truncate", "replace", "copy", "attach", "detach", "install", "load", "export", "import", "pragma", "set", "reset", "call", "grant", "revoke", "use",
    "add", "cache", "uncache", "refresh", "analyze", "msck", "explain", "describe", "show", "transform", "reflect", "java_method", "try_reflect", "read_csv", "read_parquet", "read_json", "input_file_name",
)
_WORD = re.compile(r"\b(" + "|".join(FORBIDDEN) + r")\b", re.IGNORECASE)
_PATH = re.compile(r"\b(parquet|csv|json|orc|text|avro|delta|binaryfile)\s*\.\s*`", re.IGNORECASE)


def strip_comments(sql: str) -> str:
    return re.sub(r"--[^\n]*", " ", re.sub(r"/\*.*?\*/", " ", sql, flags=re.DOTALL))


def is_safe(sql: str) -> tuple[bool, str]:
    """Whether a text is one SELECT or WITH statement without anything that writes or reaches out."""
    text = strip_comments(sql or "").strip()
    text = text[:-1].rstrip() if text.endswith(";") else text
    if not text:
        return False, "empty statement"
    if ";" in text:
        return False, "one statement only"
    if text.split(None, 1)[0].lower() not in ("select", "with"):
        return False, "only SELECT or WITH"
    if found := _WORD.search(text):
        return False, f"forbidden word: {found.group(1).lower()}"
    if _PATH.search(text):
        return False, "files cannot be read by path"
    return True, ""


class Surface:
    """Named frames behind a guard, a row limit and a time limit; errors come back as data."""

    def __init__(self, spark: SparkSession, views: dict[str, DataFrame], descriptions: dict[str, str] | None = None):
        self._session = spark.newSession()
        self._session.conf.set("spark.sql.runSQLOnFiles", "false")
        self._names = list(views)
        self._descriptions = descriptions or {}
        for name, df in views.items():
            self._register(name, df)

    def _register(self, name: str, df: DataFrame) -> None:
        """The frame's plan as a view of the guarded session, which shares the context but no settings."""
        plan = df._jdf.queryExecution().analyzed()
        dataset = self._session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self._session._jsparkSession, plan)
        DataFrame(dataset, self._session).createOrReplaceTempView(name)

    def schema(self) -> dict:
        """Views with their typed and described columns."""
        return {n: [{"name": f.name, "type": f.dataType.simpleString(), "about": self._descriptions.get(f.name, "")} for f in self._session.table(n).schema] for n in self._names}

    def query(self, sql: str, max_rows: int = 200, timeout_s: float = 10.0) -> dict:
        """``{ok, columns, rows, row_count, truncated}`` or ``{ok: False, error}``; never raises."""
        ok, why = is_safe(sql)
        if not ok:
            return {"ok": False, "error": why}
        tag, out, context = f"surface-{uuid.uuid4().hex}", {}, self._session.sparkContext

        def run() -> None:
            try:
                context.setJobGroup(tag, "guarded query", True)
                df = self._session.sql(strip_comments(sql).strip().rstrip(";")).limit(max_rows + 1)
                out["columns"], out["rows"] = df.columns, [list(r) for r in df.collect()]
            except Exception as e:  # noqa: BLE001 - errors are data here
                out["error"] = str(e).split("\n")[0][:500]

        worker = InheritableThread(target=run)
        worker.daemon = True
        worker.start()
        worker.join(timeout_s)
        if worker.is_alive():
            context.cancelJobGroup(tag)
            return {"ok": False, "error": f"stopped after {timeout_s:g} s"}
        if "error" in out:
            return {"ok": False, "error": out["error"]}
        rows = out["rows"]
        return {"ok": True, "columns": out["columns"], "rows": rows[:max_rows], "row_count": min(len(rows), max_rows), "truncated": len(rows) > max_rows}


def render(result: dict, cell: int = 120) -> str:
    """A result as compact text: nulls spelt out, floats short, control characters flattened."""
    if not result["ok"]:
        return f"error: {result['error']}"

    def show(v) -> str:
        if v is None:
            return "NULL"
        text = f"{v:.3f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
        return re.sub(r"[\x00-\x1f\x7f]", " ", text)[:cell]

    lines = [" | ".join(result["columns"]), *(" | ".join(map(show, r)) for r in result["rows"])]
    return "\n".join(lines + ["(more rows)"] * result["truncated"])
