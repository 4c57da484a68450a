"""Text scalars: sanitising, truncation, snippets, chunks, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits and markers of stored content.
MAX_FILE, MAX_SNIPPET = 10_000, 5_000
TRUNCATED = "\n... [truncated]"
BINARY = "[Binary file - content not stored]"
CHUNK, OVERLAP, DESCRIPTION = 1_200, 120, 150
HASH_VERSION = "v1"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sanitize(text: Column | str) -> Column:
    """LF line ends; no control characters (tab and LF stay), surrogates or U+FFFE/U+FFFF."""
    t = F.regexp_replace(F.regexp_replace(_c(text), "\r\n", "\n"), "\r", "\n")
    return F.regexp_replace(t, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\uD800-\\uDFFF\\uFFFE\\uFFFF]", "")


def is_binary(text: Column | str) -> Column:
    """More than a tenth of the first 1000 characters are control characters."""
    head = F.substring(_c(text), 1, 1000)
    odd = F.length(head) - F.length(F.regexp_replace(head, "[\\x00-\\x08\\x0E-\\x1F\\x7F]", ""))
    return F.coalesce((F.length(head) > 0) & (odd / F.length(head) > 0.1), F.lit(False))


def truncate(text: Column | str, limit: int) -> Column:
    t = _c(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(TRUNCATED))).otherwise(t)


def file_content(text: Column | str) -> Column:
    """What is stored of a file."""
    t = _c(text)
    return F.when(is_binary(t), BINARY).otherwise(truncate(t, MAX_FILE))


def snippet(text: Column | str, start: Column, end: Column) -> Column:
    """Lines of a symbol with two lines around it; start and end count from 0."""
    lines = F.split(_c(text), "\n")
    a = F.greatest(F.lit(0), start - 2)
    b = F.least(F.size(lines) - 1, end + 2)
    body = F.array_join(F.slice(lines, (a + 1).cast("int"), F.greatest(F.lit(0), b - a + 1).cast("int")), "\n")
    return F.when(start.isNull() | end.isNull(), "").when(is_binary(text), BINARY).otherwise(truncate(body, MAX_SNIPPET))


def character_chunks(df: DataFrame, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """df without text, plus chunk, chunk_index, start_offset, end_offset and 0-based start_line, end_line in the text."""
    length, step = F.length(text), size - overlap
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), length - 1), F.lit(step)), lambda s: (s == 0) | (s + overlap < length))
    cut = df.withColumn("start_offset", F.explode(starts)).withColumn("end_offset", F.least(F.col("start_offset") + size, length))
    chunk = F.substr(F.col(text), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    newlines = lambda n: F.size(F.split(F.substr(F.col(text), F.lit(1), n), "\n")) - 1
    out = cut.withColumn("chunk", chunk).withColumn("chunk_index", (F.col("start_offset") / step).cast("int"))
    return out.withColumn("start_line", newlines(F.col("start_offset"))).withColumn("end_line", newlines(F.greatest(F.lit(1), F.col("end_offset") - 1))).drop(text)


def clean_content(text: Column | str) -> Column:
    """Trailing blanks removed, runs of blank lines to one."""
    t = F.regexp_replace(_c(text), r"[ \t]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"\s+$", "")


def embedding_text(label: Column, name: Column, path: Column, body: Column, container: Column | None = None, members: Column | None = None, description: Column | None = None) -> Column:
    """Header of metadata, then the cleaned body."""
    lines = [F.concat(label, F.lit(": "), name), F.concat(F.lit("Path: "), path)]
    if container is not None:
        lines.append(F.when(container.isNotNull(), F.concat(F.lit("Container: "), container)))
    if members is not None:
        lines.append(F.when(F.size(members) > 0, F.concat(F.lit("Members: "), F.array_join(members, ", "))))
    if description is not None:
        lines.append(F.when(description.isNotNull(), F.substring(description, 1, DESCRIPTION)))
    return F.concat_ws("\n", *lines, F.lit(""), clean_content(body))


def content_hash(text: Column | str) -> Column:
    return F.sha1(F.concat(F.lit(HASH_VERSION), _c(text)))


def chunk_hash(files: DataFrame, key: str, path: str = "path", hash_: str = "hash") -> DataFrame:
    """(key, chunk_hash): address of a group of files by their paths and hashes."""
    return files.groupBy(key).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", path, hash_))), "\n"), 256).alias("chunk_hash"))


def capitalize(text: Column | str) -> Column:
    t = _c(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


def sanitize_id(text: Column | str) -> Column:
    return F.lower(F.substring(F.regexp_replace(_c(text), "[^a-zA-Z0-9]", "_"), 1, 20))


def line_number(text: Column | str, offset: Column) -> Column:
    """0-based line of a character offset."""
    return F.size(F.split(F.substr(_c(text), F.lit(1), offset), "\n")) - 1
