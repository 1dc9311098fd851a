"""Canonical JSON and digests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def canonical_json(json: Column) -> Column:
    """Keys sorted at every level, compact, numbers normalized (``1.0`` -> ``1``). Bad JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(json)), json)


def metadata_fingerprint(metadata_json: Column) -> Column:
    """Equality key of a metadata object; a missing object equals an empty one."""
    return F.coalesce(canonical_json(F.nullif(metadata_json, F.lit(""))), F.lit("{}"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def json_digest(json: Column) -> Column:
    return digest(canonical_json(json))


def struct_digest(*columns: Column) -> Column:
    """Digest of named columns, keys sorted, nulls kept."""
    return json_digest(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def case_id(event_json: Column, candidates_json: Column, prompt_version: str = "semantic-new-v1") -> Column:
    """Stable id of an adjudication case: ``rc_`` and 24 hex digits."""
    body = F.concat(
        F.lit('{"candidates":'), canonical_json(candidates_json), F.lit(',"event":'), canonical_json(event_json),
        F.lit(f',"prompt_version":"{prompt_version}"}}'),
    )
    return F.concat(F.lit("rc_"), F.substring(digest(body), 1, 24))


def short_id(prefix: str, digits: int, *parts: Column) -> Column:
    """Deterministic id in place of a random one, so that reruns agree."""
    return F.concat(F.lit(prefix), F.substring(digest(F.concat_ws(":", *parts)), 1, digits))
