"""Column expressions for identifiers, tokens and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions.text import _col, strip

_DOI_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"
_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_KIND = r"^[A-Za-z][A-Za-z0-9._-]*$"
STRONG_IDENTIFIERS = ["doi"]
RESERVED_IDENTIFIERS = ["id"]


def is_doi(c) -> Column:
    """True for an already normalised DOI."""
    c = _col(c)
    return F.coalesce(c.startswith("10.") & c.contains("/") & ~c.rlike(r"(?U)\s"), F.lit(False))


def norm_doi(c) -> Column:
    """Canonical lower-case DOI; null when invalid."""
    bare = F.lower(strip(F.regexp_replace(strip(c), _DOI_PREFIX, "")))
    return F.when(is_doi(bare), bare)


def norm_uuid(c) -> Column:
    """Lower-case hyphenated UUID; null when invalid."""
    c = _col(c)
    return F.when(c.rlike(_UUID), F.lower(c))


def norm_identifiers(c) -> Column:
    """Normalised identifier map; null when any entry is invalid. A later key wins."""
    entries = F.map_entries(_col(c))
    cleaned = F.transform(
        entries,
        lambda e: F.struct(
            F.lower(strip(e["key"])).alias("key"),
            F.when(F.lower(strip(e["key"])) == "doi", norm_doi(e["value"])).otherwise(strip(e["value"])).alias("value"),
        ),
    )
    last = F.filter(
        cleaned,
        lambda e, i: ~F.exists(F.slice(cleaned, i + 2, F.size(cleaned)), lambda later: later["key"] == e["key"]),
    )
    bad = F.exists(
        cleaned,
        lambda e: (e["key"] == "") | e["key"].isin(RESERVED_IDENTIFIERS) | F.coalesce(e["value"] == "", F.lit(True)),
    )
    return F.when(_col(c).isNotNull() & ~bad, F.map_from_entries(last))


def strong_ids(c) -> Column:
    """Array of ``(name, value)`` that may identify a record: DOI only."""
    return F.filter(F.map_entries(norm_identifiers(c)), lambda e: e["key"].isin(STRONG_IDENTIFIERS))


def parse_token(c, kinds: list[str] | None = None, legacy: bool = False) -> Column:
    """``struct(kind, value)`` of a typed token, null when malformed or of another kind.

    ``legacy`` also takes a bare DOI in any of its written forms.
    """
    raw = strip(c)
    kind = F.lower(strip(F.split_part(raw, F.lit(":"), F.lit(1))))
    rest = strip(F.substr(raw, F.instr(raw, ":") + F.lit(1)))
    value = (
        F.when(kind == "doi", norm_doi(rest)).when(kind == "id", norm_uuid(rest)).otherwise(F.nullif(rest, F.lit("")))
    )
    ok = raw.contains(":") & kind.rlike(_KIND) & value.isNotNull()
    typed = F.when(ok, F.struct(kind.alias("kind"), value.alias("value")))
    token = typed
    if legacy:
        token = F.when(
            norm_doi(raw).isNotNull(), F.struct(F.lit("doi").alias("kind"), norm_doi(raw).alias("value"))
        ).otherwise(typed)
    if kinds is not None:
        token = F.when(token["kind"].isin([k.strip().lower() for k in kinds]), token)
    return token


def token_text(token: Column) -> Column:
    return F.concat_ws(":", token["kind"], token["value"])


def registry_token(doi, pub_id) -> Column:
    """Registry form: the DOI when present, else the record id."""
    return F.coalesce(F.concat(F.lit("doi:"), norm_doi(doi)), F.concat(F.lit("id:"), norm_uuid(pub_id)))


def identity_label(doi, pub_id) -> Column:
    """Display form: a bare DOI, else the tagged record id."""
    return F.coalesce(norm_doi(doi), F.concat(F.lit("id:"), norm_uuid(pub_id)))


def fingerprint(**columns) -> Column:
    """SHA-256 of the compact JSON object of ``columns`` with sorted keys."""
    fields = [_col(columns[name]).alias(name) for name in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def sorted_map(c) -> Column:
    """Map with its entries in key order, so that its JSON is canonical."""
    return F.map_from_entries(F.sort_array(F.map_entries(_col(c))))
