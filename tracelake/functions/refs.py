"""References: parse, format, classify and resolve (columns, no UDFs).

A reference is six nullable string columns: user, archive, session, file,
collection, asset. Two spellings exist: a compact one (``archive|session/file``)
and a full URI (``scheme user/archive/session/file``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import WHITESPACE, WHITESPACE_CHARACTERS, strip

PARTS = ("user", "archive", "session", "file", "collection", "asset")

# Fixed values of the reference notation.
DEFAULT_SCHEME = "prov://"
ARCHIVE_SEPARATOR = "|"
PATH_SEPARATOR = "/"
COLLECTIONS_SEGMENT = "collections"
ASSETS_SEGMENT = "assets"
SESSION_TOKEN = r"^[SI]-\d{2}-\d+$"
ASSET_TOKEN = r"^AF-\d{2}-\d+$"

#: Characters no text may hold (Unicode noncharacters), used as delimiters.
MARK = "\uffff"
VALUE_MARK = "\ufffe"


def _blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def _patterns(scheme: str) -> dict[str, str]:
    """Whole-text patterns of the three well-formed spellings."""
    w = WHITESPACE + "*"

    def token(forbidden: str) -> str:
        edge = f"[^{forbidden}{WHITESPACE_CHARACTERS}]"
        return f"({edge}(?:[^{forbidden}]*{edge})?)"

    uri_token, name, archive = token("/"), token("/|"), token("|")
    head = f"(?si)^{w}{re.escape(scheme)}"
    compact = f"(?s)^(?!{MARK})(?!(?i){w}{re.escape(scheme)}){w}(?:{archive}{w}\\|)?{w}"
    more = f"(?:/+{w}{uri_token}{w})?"
    return {
        "starts_uri": head,
        "uri": f"{head}{w}{uri_token}{w}/{w}{uri_token}{w}{more}{more}/*{w}$",
        "pair": f"{compact}{name}{w}/{w}{name}{w}$",
        "bare": f"{compact}{name}{w}$",
    }


def _blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def _fields(raw: Column, scheme: str) -> Column:
    """A well-formed text rewritten as named fields, a malformed one left alone.

    Each field is a mark, its name, a second mark and its value. Every part of a
    reference is then one map lookup in one expression, which stays small when a
    predicate on it is pushed to the scan.
    """
    m, k = MARK, VALUE_MARK
    pattern = _patterns(scheme)
    either = f"{COLLECTIONS_SEGMENT}|{ASSETS_SEGMENT}"
    rewrites = (
        (pattern["uri"], f"{m}user{k}$1{m}archive{k}$2{m}session{k}$3{m}file{k}$4"),
        (pattern["pair"], f"{m}archive{k}$1{m}session{k}$2{m}file{k}$3"),
        (pattern["bare"], f"{m}archive{k}$1{m}bare{k}$2"),
        (f"(?s)^{m}.*{m}session{k}(?:{either}){m}file{k}$", ""),
        (f"{m}session{k}{COLLECTIONS_SEGMENT}{m}file{k}", f"{m}collection{k}"),
        (f"{m}session{k}{ASSETS_SEGMENT}{m}file{k}", f"{m}asset{k}"),
        (f"{m}bare{k}({SESSION_TOKEN[1:]})", f"{m}session{k}$1"),
        (f"{m}bare{k}({ASSET_TOKEN[1:]})", f"{m}asset{k}$1"),
        (f"{m}bare{k}", f"{m}file{k}"),
        (f"{m}[a-z]+{k}(?={m}|$)", ""),
    )
    for found, written in rewrites:
        raw = F.regexp_replace(raw, found, written)
    return raw


def parse_refs(df: DataFrame, text: str, prefix: str = "ref_",
               scheme: str = DEFAULT_SCHEME) -> DataFrame:
    """Add the six parts of the reference in column ``text`` plus ``<prefix>error``.

    A malformed reference gives a null in every part and the class of the
    mistake in the error column; a good one gives a null error.
    """
    raw, pattern = F.col(text), _patterns(scheme)
    siblings = (COLLECTIONS_SEGMENT, ASSETS_SEGMENT)
    fields = _fields(raw, scheme)
    values = F.str_to_map(fields, F.lit(MARK), F.lit(VALUE_MARK))
    parts = {name: F.try_element_at(values, F.lit(name)) for name in PARTS}
    # What is wrong with the rest, looked at only when no spelling fits.
    segments = F.split(F.regexp_replace(raw, pattern["starts_uri"], ""), PATH_SEPARATOR, -1)
    following = F.filter(F.slice(segments, F.lit(3), F.size(segments)), lambda p: ~_blank(p))
    named = F.get(following, F.lit(0)).isin(*siblings)
    bars = F.split(raw, r"\|", -1)
    body = F.element_at(bars, -1)
    tail = F.regexp_replace(body, "(?s)^[^/]*/", "")
    mistake = (
        F.when(_blank(raw), "empty")
        .when(raw.rlike(pattern["starts_uri"]),
              F.when((F.size(segments) < 2) | _blank(F.get(segments, F.lit(0)))
                     | _blank(F.get(segments, F.lit(1))), "bad_uri")
              .when(named, "bad_sibling_uri")
              .when(F.size(following) > 2, "too_many_segments").otherwise("empty_segment"))
        .when(F.size(bars) > 2, "multiple_archive_separators")
        .when((F.size(bars) == 2) & _blank(F.get(bars, F.lit(0))), "empty_archive")
        .when((F.size(bars) == 2) & _blank(body), "nothing_after_archive")
        .when(_blank(F.substring_index(body, PATH_SEPARATOR, 1)) | _blank(tail), "empty_segment")
        .when(strip(F.substring_index(body, PATH_SEPARATOR, 1)).isin(*siblings),
              "separator_in_segment")
        .otherwise("too_many_segments")
    )
    return df.withColumns({
        **{prefix + name: part for name, part in parts.items()},
        prefix + "error": F.when(~F.coalesce(fields.startswith(MARK), F.lit(False)), mistake),
    })


def _part(prefix: str, name: str) -> Column:
    return _blank_to_null(F.col(prefix + name))


def format_uri(prefix: str = "ref_", scheme: str = DEFAULT_SCHEME,
               user: Column | None = None, archive: Column | None = None) -> Column:
    """Full spelling; ``user``/``archive`` fill in what the reference leaves out.

    Null when no owner or archive is known, or a file has no session.
    """
    none = F.lit(None).cast("string")
    owner = F.coalesce(_part(prefix, "user"), none if user is None else _blank_to_null(user))
    arc = F.coalesce(_part(prefix, "archive"), none if archive is None else _blank_to_null(archive))
    session, file = _part(prefix, "session"), _part(prefix, "file")
    collection, asset = _part(prefix, "collection"), _part(prefix, "asset")
    tail = (
        F.when(collection.isNotNull(), F.concat(F.lit(f"/{COLLECTIONS_SEGMENT}/"), collection))
        .when(asset.isNotNull(), F.concat(F.lit(f"/{ASSETS_SEGMENT}/"), asset))
        .when(file.isNotNull(), F.concat(F.lit("/"), session, F.lit("/"), file))
        .when(session.isNotNull(), F.concat(F.lit("/"), session))
        .otherwise("")
    )
    return F.concat(F.lit(scheme), owner, F.lit("/"), arc, tail)


def format_ref(prefix: str = "ref_", scheme: str = DEFAULT_SCHEME) -> Column:
    """Shortest spelling; a reference that names an owner is always a URI."""
    session, file = _part(prefix, "session"), _part(prefix, "file")
    collection, asset = _part(prefix, "collection"), _part(prefix, "asset")
    archive = _part(prefix, "archive")
    body = (
        F.when(collection.isNotNull(), F.concat(F.lit(f"{COLLECTIONS_SEGMENT}/"), collection))
        .when(asset.isNotNull(), F.concat(F.lit(f"{ASSETS_SEGMENT}/"), asset))
        .when(file.isNotNull() & session.isNotNull(), F.concat(session, F.lit("/"), file))
        .otherwise(F.coalesce(file, session))
    )
    compact = F.when(body.isNull(), archive).when(
        archive.isNotNull(), F.concat(archive, F.lit(ARCHIVE_SEPARATOR), body)).otherwise(body)
    return F.when(_part(prefix, "user").isNotNull(), format_uri(prefix, scheme)).otherwise(compact)


def ref_kind(prefix: str = "ref_") -> Column:
    return (
        F.when(_part(prefix, "collection").isNotNull(), "collection")
        .when(_part(prefix, "asset").isNotNull(), "asset")
        .when(_part(prefix, "file").isNotNull(), "file")
        .when(_part(prefix, "session").isNotNull(), "session")
        .otherwise("archive")
    )


def is_cross_archive(prefix: str = "ref_") -> Column:
    return F.col(prefix + "archive").isNotNull()


def is_cross_user(prefix: str = "ref_") -> Column:
    return F.col(prefix + "user").isNotNull()


def is_same_session(prefix: str = "ref_") -> Column:
    return (F.col(prefix + "session").isNull() & F.col(prefix + "collection").isNull()
            & F.col(prefix + "asset").isNull())


def resolve_in_context(df: DataFrame, archive: Column, session: Column,
                       user: Column | None = None, prefix: str = "ref_",
                       out: str = "to_") -> DataFrame:
    """Fill the implicit parts from where the reference was written.

    Collections and assets live beside sessions, so they never inherit one.
    """
    sibling = F.col(prefix + "collection").isNotNull() | F.col(prefix + "asset").isNotNull()
    none = F.lit(None).cast("string")
    return df.withColumns({
        out + "user": F.coalesce(_part(prefix, "user"), none if user is None else user),
        out + "archive": F.coalesce(_part(prefix, "archive"), archive),
        out + "session": F.coalesce(_part(prefix, "session"), F.when(~sibling, session)),
        out + "file": F.col(prefix + "file"),
        out + "collection": F.col(prefix + "collection"),
        out + "asset": F.col(prefix + "asset"),
    })


def canonical_refs(df: DataFrame, text: str, out: str = "canonical",
                   scheme: str = DEFAULT_SCHEME) -> DataFrame:
    """The shortest spelling of what ``text`` names, null when malformed.

    Equals parsing and formatting again, but only rewrites the text.
    """
    m, k = MARK, VALUE_MARK
    any_value = f"([^{m}{k}]*)"
    fields = _fields(F.col(text), scheme)
    for found, written in (
        (f"^{m}user{k}{any_value}{m}archive{k}{any_value}", f"{m}{scheme}$1/$2"),
        (f"^{m}archive{k}{any_value}", f"{m}$1{ARCHIVE_SEPARATOR}"),
        (f"(?<=[^{m}{ARCHIVE_SEPARATOR}]){m}", f"/{m}"),
        (f"{m}collection{k}", f"{m}{COLLECTIONS_SEGMENT}/"),
        (f"{m}asset{k}", f"{m}{ASSETS_SEGMENT}/"),
        (f"{m}(?:session|file){k}", m),
        (f"(?s)(?<=.){m}", ""),
    ):
        fields = F.regexp_replace(fields, found, written)
    # A leading mark says well-formed; splitting there gives null otherwise.
    return df.withColumn(out, F.get(F.split(fields, f"^{m}", 2), F.lit(1)))
