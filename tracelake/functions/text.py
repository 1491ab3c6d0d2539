"""Tags, names, labels, sizes, hashes and other text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as white space; characters a tag may not hold; characters a collection name may
# not hold; device names it may not take; the length it may not pass; the shape
# of a saved-search name; the suffix of a sidecar; the size units; the file
# types shown inline and their size ceiling.
WHITESPACE_CHARACTERS = (r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WHITESPACE = f"[{WHITESPACE_CHARACTERS}]"
TAG_FORBIDDEN = r"[,\n\r\t]"
COLLECTION_ILLEGAL = r'/\|:*?"<>'
COLLECTION_RESERVED = (
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
)
COLLECTION_MAX_LENGTH = 120
SEARCH_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
SIDECAR_SUFFIX = ".meta.json"
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
PREVIEW_SUFFIXES = (".svg", ".png", ".jpg", ".jpeg", ".gif", ".webp")
PREVIEW_MAX_BYTES = 2 * 1024 * 1024
STATUS_LABELS = {"paired": "OK", "orphan": "no metadata",
                 "stray": "data missing", "drifted": "modified"}
SOURCE_FACETS = ("script", "external", "unrecorded")


def strip(text: Column) -> Column:
    """Remove outer white space of every kind."""
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


# -- tags -----------------------------------------------------------------

def clean_tag(tag: Column) -> Column:
    """One tag with whitespace collapsed; null when it cannot be a tag."""
    text = F.regexp_replace(F.regexp_replace(tag, f"{WHITESPACE}+", " "), r"^ | $", "")
    return F.when(~tag.rlike(TAG_FORBIDDEN) & (text != ""), text)


def clean_tags(tags: Column) -> Column:
    """Usable tags in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(tags, clean_tag), lambda t: t.isNotNull()))


def bad_tags(tags: Column) -> Column:
    """The entries :func:`clean_tags` rejects, as written."""
    return F.filter(tags, lambda t: clean_tag(t).isNull())


def split_tags(text: Column) -> Column:
    """Tags of a comma-separated field; blank pieces are skipped, not errors."""
    return clean_tags(F.filter(F.split(text, ","), lambda t: ~t.rlike(f"^{WHITESPACE}*$")))


# -- names ----------------------------------------------------------------

def _reserved(name: Column) -> Column:
    return F.upper(F.substring_index(name, ".", 1)).isin(*COLLECTION_RESERVED)


def slugify(display: Column) -> Column:
    """A usable collection name made from any text."""
    swapped = F.translate(strip(display),
                          COLLECTION_ILLEGAL, "-" * len(COLLECTION_ILLEGAL))
    visible = F.regexp_replace(swapped, r"[\x00-\x1f]", "")
    trimmed = F.regexp_replace(strip(visible), r"\.+$", "")
    squeezed = F.regexp_replace(trimmed, WHITESPACE + "{2,}", " ")
    named = (
        F.when(squeezed == "", F.lit("collection"))
        .when(_reserved(squeezed),
              F.regexp_replace(F.concat(squeezed, F.lit("-collection")), r"^-+|-+$", ""))
        .otherwise(squeezed)
    )
    return F.substring(named, 1, COLLECTION_MAX_LENGTH)


def collection_name_problem(name: Column) -> Column:
    """Why a collection name is refused; null when it is fine."""
    value = strip(name)
    return (
        F.when(F.coalesce(value, F.lit("")) == "", "empty")
        .when(value.rlike(r'[/\\|:*?"<>]'), "illegal_character")
        .when(value.rlike(r"[\x00-\x1f]"), "control_character")
        .when(value.endswith("."), "trailing_dot")
        .when(_reserved(value), "reserved")
        .when(F.length(value) > COLLECTION_MAX_LENGTH, "too_long")
    )


def search_name_ok(name: Column) -> Column:
    return F.coalesce(strip(name).rlike(SEARCH_NAME), F.lit(False))


def rename_problem(old: Column, new: Column) -> Column:
    """Why an artifact cannot take this name (clashes are a join, not text)."""
    return (
        F.when(F.coalesce(new, F.lit("")) == "", "not_a_plain_name")
        .when(new.contains("/"), "not_a_plain_name")
        .when(new.startswith(".") | new.endswith(SIDECAR_SUFFIX), "not_an_artifact_name")
        .when(new == old, "same_name")
    )


# -- labels ---------------------------------------------------------------

def human_size(size: Column, gap: str = " ") -> Column:
    """1024-step size: whole bytes, one decimal above; ties round to even."""
    value, out = size.cast("double"), None
    for i, unit in enumerate(SIZE_UNITS):
        scaled = value / float(1024 ** i)
        text = F.format_string("%.0f" if i == 0 else "%.1f", F.bround(scaled, 0 if i == 0 else 1))
        text = F.concat(text, F.lit(gap + unit))
        if out is None:
            out = F.when(scaled < 1024, text)
        elif unit == SIZE_UNITS[-1]:
            out = out.otherwise(text)
        else:
            out = out.when(scaled < 1024, text)
    return F.when(size.isNotNull(), out)


def provenance_label(source: Column, origin: Column, repo: Column, commit: Column,
                     dirty: Column) -> Column:
    """``repo@commit8 (dirty)``, or where an external file came from."""
    def or_else(text: Column, instead: str) -> Column:
        return F.when(F.coalesce(text, F.lit("")) == "", instead).otherwise(text)

    code = F.concat(or_else(repo, "-"), F.lit("@"), or_else(F.substring(commit, 1, 8), "-"),
                    F.when(dirty, " (dirty)").otherwise(""))
    return F.when(source == "external", F.concat(
        F.lit("external: "), or_else(origin, "(no origin recorded)"))).otherwise(code)


def ref_label(archive: Column, session: Column, file: Column) -> Column:
    return F.concat(F.coalesce(archive, F.lit("(local)")), F.lit("|"),
                    F.coalesce(session, F.lit("(same session)")), F.lit("/"),
                    F.coalesce(file, F.lit("(whole session)")))


def status_label(status: Column) -> Column:
    out = status
    for key, label in STATUS_LABELS.items():
        out = F.when(status == key, label).otherwise(out)
    return out


def source_facet(source: Column, recorded: Column) -> Column:
    """How the file got here; a default that nobody wrote down is no answer."""
    return F.when(recorded & source.isin("script", "external"), source).otherwise("unrecorded")


def activity_shade(n: Column, busiest: Column) -> Column:
    """0 for nothing, then 1..3 by share of the busiest day."""
    share = n / busiest
    return (F.when(F.coalesce(n, F.lit(0)) == 0, 0).when(busiest <= 1, 3)
            .when(share > 0.66, 3).when(share > 0.33, 2).otherwise(1))


# -- paths and links ------------------------------------------------------

def suffix_of(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"^.+(\.[^.]+)$", 1))


def previewable(filename: Column, size: Column) -> Column:
    return (suffix_of(filename).isin(*PREVIEW_SUFFIXES)
            & (F.coalesce(size, F.lit(0)) <= PREVIEW_MAX_BYTES))


def unsafe_path(path: Column) -> Column:
    """A stored path that would leave its folder when written out."""
    return (path.startswith("/") | path.startswith("\\") | path.rlike(r"^[A-Za-z]:")
            | F.array_contains(F.split(path, r"[/\\]"), ".."))


def web_remote(remote: Column) -> Column:
    """Browsable address of a code remote; null when there is none."""
    scp = r"^git@([^:]*):?(.*)$"
    https = F.when(remote.startswith("git@"),
                   F.concat(F.lit("https://"), F.regexp_extract(remote, scp, 1), F.lit("/"),
                            F.regexp_extract(remote, scp, 2))).otherwise(remote)
    bare = F.regexp_replace(F.trim(https), r"\.git$", "")
    return F.when(bare.startswith("http"), bare)


def source_link(remote: Column, commit: Column, entry_point: Column) -> Column:
    return F.concat(web_remote(remote), F.lit("/blob/"), commit, F.lit("/"), entry_point)


# -- hashes ---------------------------------------------------------------

def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def json_string(text: Column) -> Column:
    """JSON text of a string in pure ASCII, as a manifest id is hashed over.

    ``to_json`` escapes quotes, backslashes and control characters; what is
    left above ASCII is written as UTF-16 code units.
    """
    quoted = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    units = F.transform(
        F.filter(F.split(quoted, ""), lambda ch: ch != ""),
        lambda ch: F.when(ch.rlike(r"^[\x00-\x7e]$"), ch).otherwise(
            F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), r"(.{4})", r"\\u$1")),
    )
    return F.when(quoted.rlike(r"^[\x00-\x7e]*$"), quoted).otherwise(F.array_join(units, ""))


def manifest_id(entry: Column, files: Column) -> Column:
    """Id of one manifest from its entry point and its array of (path, blob)."""
    pairs = F.transform(F.array_sort(files), lambda f: F.concat(
        json_string(f["path"]), F.lit(":"), json_string(f["blob"])))
    text = F.concat(
        F.lit('{"entry":'), F.coalesce(json_string(entry), F.lit("null")),
        F.lit(',"files":{'), F.array_join(pairs, ","), F.lit("}}"))
    return F.sha2(text, 256)


def manifest_rows(files: DataFrame) -> DataFrame:
    """(manifest, id) of manifests given as rows of manifest, entry, path and blob.

    A manifest of any size needs no array: its rows are sorted by path outside
    memory and one running hash goes over them. Rows that are alike in manifest
    and path count once, with the least blob; a null path counts as no file, so
    that a manifest without files can be given by its entry alone.
    """
    import hashlib

    def hashed(batches):
        import pandas as pd

        at, digest = None, None
        for batch in batches:
            done = []
            for manifest, head, pair in zip(batch["manifest"], batch["head"], batch["pair"]):
                if digest is None or manifest != at:
                    if digest is not None:
                        digest.update(b"}}")
                        done.append((at, digest.hexdigest()))
                    at, digest, first = manifest, hashlib.sha256(head.encode()), True
                if pair is not None:
                    digest.update(pair.encode() if first else b"," + pair.encode())
                    first = False
            yield pd.DataFrame(done, columns=["manifest", "id"])
        if digest is not None:
            digest.update(b"}}")
            yield pd.DataFrame([(at, digest.hexdigest())], columns=["manifest", "id"])

    one = files.where("manifest is not null").groupBy("manifest", "path").agg(F.min("entry").alias("entry"), F.min("blob").alias("blob"))
    head = F.concat(F.lit('{"entry":'), F.coalesce(json_string(F.col("entry")), F.lit("null")), F.lit(',"files":{'))
    pair = F.concat(json_string(F.col("path")), F.lit(":"), F.coalesce(json_string(F.col("blob")), F.lit("null")))
    ordered = one.select("manifest", "path", head.alias("head"), F.when(F.col("path").isNotNull(), pair).alias("pair")).repartition(
        "manifest").sortWithinPartitions("manifest", "path")
    return ordered.select("manifest", "head", "pair").mapInPandas(hashed, "manifest string, id string")


def hash_bytes(text: Column) -> Column:
    """A SHA-256 in lower-case hex as 33 bytes, any other text as its own behind another first byte."""
    return F.when(text.rlike("^[0-9a-f]{64}\\z"), F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(
        F.concat(F.lit(b"\x00"), F.encode(text, "UTF-8")))


def hash_text(packed: Column) -> Column:
    """What :func:`hash_bytes` was given."""
    rest = F.substring(packed, F.lit(2), F.octet_length(packed))
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))
