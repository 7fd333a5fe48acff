"""Column functions over workspace paths and URIs. Lexical only: no path is ever opened."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def decode_percent(c: Column) -> Column:
    """Percent encoding undone; a plus stays a plus; null where the encoding is broken."""
    return F.try_url_decode(F.regexp_replace(c, r"\+", "%2B"))


def _after_uri(c: Column) -> Column:
    host = F.regexp_extract(c, r"(?i)^file://([^/]*)", 1)
    path = decode_percent(F.regexp_replace(c, r"(?i)^file:(?://[^/]*)?", ""))
    return F.when(~c.rlike("(?i)^file:"), c).when((host == "") | (F.lower(host) == "localhost"), path).otherwise(F.concat(F.lit("//"), host, path))


def _collapse(parts: Column, absolute: Column, keep: int = 0) -> Column:
    """Dots and empty parts resolved; .. doesn't climb above the root, nor above the first keep parts."""
    start = F.array().cast("array<string>")

    def step(a, x):
        up = F.when((F.size(a) > keep) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != ".."), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(~absolute, F.concat(a, F.array(x))).otherwise(a)
        return F.when((x == "") | (x == "."), a).when(x == "..", up).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(parts, start, step)


def normalize_path(c: Column) -> Column:
    """One spelling of a workspace path: file URIs decoded, slashes forward, drives and /mnt/x as x:/ in lower case, UNC in lower case, dots resolved, no slash at the end. Null for null, empty and broken URIs."""

    def body(v):
        drive = r"(?i)^(?:/?([a-z]):|/mnt/([a-z]))(?:/(.*))?$"
        letter = F.lower(F.concat(F.regexp_extract(v, drive, 1), F.regexp_extract(v, drive, 2)))
        rest = F.lower(F.array_join(_collapse(F.split(F.regexp_extract(v, drive, 3), "/"), F.lit(True)), "/"))
        unc = F.lower(F.array_join(_collapse(F.split(F.substring(v, 3, 1 << 20), "/"), F.lit(True), 2), "/"))
        plain = F.array_join(_collapse(F.split(v, "/"), v.startswith("/")), "/")
        return F.when(v.rlike(drive), F.concat(letter, F.lit(":/"), rest)).when(v.startswith("//"), F.concat(F.lit("//"), unc)).when(v.startswith("/"), F.concat(F.lit("/"), plain)).otherwise(F.when(plain == "", ".").otherwise(plain))

    value = F.regexp_replace(_after_uri(F.when(c != "", c)), r"\\", "/")
    return F.get(F.transform(F.array(value), lambda v: F.when(v.isNotNull(), body(v))), F.lit(0))


def is_internal_label(c: Column) -> Column:
    """Labels for display that are no paths."""
    return F.trim(c).rlike(r"(?i)^(?:global|unknown|\((?:global|unknown workspace|workspace:\s*[^)]*)\))$")


def public_path(c: Column) -> Column:
    p = normalize_path(c)
    return F.when(~is_internal_label(c) & ~is_internal_label(p), p)


def components(path: Column) -> Column:
    """Parts of a normalised path, drive and UNC server aside."""
    return F.filter(F.split(F.regexp_replace(path, r"^(?:[a-z]:/|//[^/]*/?[^/]*)", ""), "/"), lambda x: x != "")


def ends_with_components(path: Column, wanted: Column) -> Column:
    """Whether the last whole components of a path are those wanted; drives and UNC paths compare without case."""
    have, want = components(path), components(wanted)
    fold = path.rlike("^(?:[a-z]:/|//)") | wanted.rlike("^(?:[a-z]:/|//)")
    tail = F.slice(have, F.greatest(F.size(have) - F.size(want) + 1, F.lit(1)), F.size(want))
    same = F.when(fold, F.lower(F.array_join(tail, "/")) == F.lower(F.array_join(want, "/"))).otherwise(F.array_join(tail, "/") == F.array_join(want, "/"))
    anchor = F.regexp_extract(wanted, "^([a-z]:/|//[^/]*/[^/]*)", 1)
    return (F.size(want) > 0) & (F.size(want) <= F.size(have)) & same & ((anchor == "") | path.startswith(anchor))


def project_slug(cwd: Column) -> Column:
    """Directory name of a workspace path: drive in lower case, outer slashes off, slashes and colons as dashes."""
    p = F.regexp_replace(cwd, r"\\", "/")
    p = F.when(p.rlike("^[A-Za-z]:(/|$)"), F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))).otherwise(p)
    return F.regexp_replace(F.regexp_replace(p, "^/+|/+$", ""), "[/:]+", "-")


def rebase(path: Column, source: Column, target: Column) -> Column:
    """path with the prefix source replaced by target; null if path is neither source nor below it."""
    return F.when(path == source, target).when(F.startswith(path, F.concat(source, F.lit("/"))), F.concat(target, F.substring(path, F.length(source) + 1, F.length(path))))


def is_nested(path: Column, above: Column) -> Column:
    return F.startswith(path, F.concat(F.regexp_replace(above, "/+$", ""), F.lit("/")))


def dashed_uuid(c: Column) -> Column:
    """32 hexadecimal digits as 8-4-4-4-12 in lower case; null for anything else."""
    return F.when(c.rlike("^[0-9a-fA-F]{32}$"), F.lower(F.regexp_replace(c, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")))


def guids(*columns: Column) -> Column:
    """Distinct GUIDs in texts, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.concat_ws(" ", *columns), F.lit(f"({GUID})"), F.lit(1)), F.lower))


def file_uri(path: Column) -> Column:
    """A path as file URI; what isn't unreserved or a slash is percent-encoded."""
    coded = F.regexp_replace(F.url_encode(path), r"\+", "%20")
    for code, sign in (("%2F", "/"), ("%3A", ":"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        coded = F.regexp_replace(coded, code, sign)
    return F.concat(F.when(path.startswith("/"), "file://").otherwise("file:///"), coded)
