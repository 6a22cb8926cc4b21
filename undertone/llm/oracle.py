"""ANSI SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_RANKED = """
with members as (select distinct cluster_key, unnest(members) as track_id from duplicate_clusters),
cached as (select track_id, bool_or(coalesce(is_cached, false)) as is_cached from dedup_records group by 1),
ranked as (
  select m.cluster_key, m.track_id, t.*, row_number() over (
    partition by m.cluster_key order by case when c.is_cached then 0 else 1 end, t.duration_ms desc nulls last, m.track_id) as pos
  from members m left join cached c on c.track_id = m.track_id
  left join (select spotify_track_id, isrc, album_release_date, popularity, album_image_url, duration_ms from track_meta) t on t.spotify_track_id = m.track_id
  where m.track_id is not null and m.cluster_key is not null),
offered as (
  select cluster_key, track_id, pos, 'record' as field_name from ranked
  union all select cluster_key, track_id, pos, 'isrc' from ranked where regexp_matches(isrc, '\\S')
  union all select cluster_key, track_id, pos, 'album_release_date' from ranked where regexp_matches(album_release_date, '\\S')
  union all select cluster_key, track_id, pos, 'popularity' from ranked where popularity is not null
  union all select cluster_key, track_id, pos, 'album_image_url' from ranked where regexp_matches(album_image_url, '\\S')
  union all select cluster_key, track_id, pos, 'duration_ms' from ranked where duration_ms is not null)
select cluster_key, field_name, arg_min(track_id, pos) as track_id from offered group by 1, 2
"""

_COMPONENTS = """
with recursive e as (
  select track_id_a as a, track_id_b as b from match_pairs where accepted and track_id_a <> track_id_b
  union select track_id_b, track_id_a from match_pairs where accepted and track_id_a <> track_id_b),
walk(track_id, seen) as (select a, a from e union select e.a, w.seen from e join walk w on w.track_id = e.b)
select track_id, min(seen) as group_id from walk group by 1
"""


_PERCEPTUAL = ["tempo", "key", "mode", "duration_sec", "loudness_db", "time_signature", "energy", "danceability", "acousticness", "speechiness", "brightness", "punch", "dynamics", "valence_proxy"]


def _number(key: str) -> str:
    text = f"trim(json_extract_string(features, '$.{key}'))"
    return f"case when json_valid(features) and regexp_matches({text}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') and isfinite(try_cast({text} as double)) then try_cast({text} as double) end as {key}"


_COUNTED = f"""
with p as (select version, {", ".join(_number(c) for c in _PERCEPTUAL)} from track_perceptual),
l as (unpivot p on {", ".join(_PERCEPTUAL)} into name feature value x),
c as (select version, feature, count(*) as n from l group by 1, 2)
select version, feature, share, n, true as within from c, unnest([0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]::double[]) s(share)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _RANKED, "p4_verified": _COUNTED, "p7_found": _COMPONENTS}
