"""Fill-in-middle: documents cut at line borders and put together again as prefix, suffix and middle."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from .common import short_batches

#: A line with its end, or a last one without.
LINE = r"[^\n]*\n|[^\n]+"
#: Characters given to the pre-tokenizer at a time; a line longer than that is given whole.
STRETCH = 1 << 16

# What marks the prefix, the suffix and the middle in an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def stretches(text: str):
    """(start, end) of stretches that end behind a line's end, or with the text: matches begin anew there."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= STRETCH else text.rfind("\n", at, at + STRETCH) + 1 or text.find("\n", at + STRETCH) + 1 or len(text)
        yield at, end
        at = end


def unit_ends(text: str, split: pre_tokenizers.Split) -> np.ndarray:
    """Where each unit of a text ends, in code points: the offsets of isolated matches, ranked as they are read.

    The pre-tokenizer tells code points, whatever bytes they take. The first entry is 0, so n units make n + 1 entries.
    """
    ends = [np.zeros(1, np.int64)]
    for a, b in stretches(text):
        ends.append(np.fromiter((a + end for _, (_, end) in split.pre_tokenize_str(text[a:b])), np.int64))
    return np.concatenate(ends)


def draws(doc_id, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that follow from seed and id alone; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def transform(text: str | None, doc_id, split: pre_tokenizers.Split, seed: int = 7, rate: int = 100, spm: int = 50) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    text = text or ""
    ends = unit_ends(text, split)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (int(ends[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), a row per document, row by row without a shuffle.

    Two cuts at line borders are drawn from a hash of seed and id, so an order of rows or partitions changes nothing.
    rate: per cent of documents that are transformed; spm: per cent of those whose suffix comes first. Texts that are
    empty, or that hold a mark already, stay plain; so their output is the text, and any output can be put back together.

    A null or empty text has no units and stays plain with an empty output. A null id draws as an empty one. Rows that
    repeat, or share an id, are transformed alike. An empty table gives an empty one; other columns are not read.
    """

    def run(batches):
        split = pre_tokenizers.Split(Regex(LINE), "isolated")
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, len(whole), 256)):
                rows = [transform(t, i, split, seed, rate, spm) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    short_batches(documents.sparkSession)
    inner = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = inner.schema["doc_id"].dataType.simpleString()
    return inner.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A mark stands once in an output that is not plain, so it parts it."""
    part = lambda s, mark, k: F.split_part(s, F.lit(mark), F.lit(k))
    middle = part(output, MIDDLE, 2)
    psm = F.concat(part(part(output, SUFFIX, 1), PREFIX, 2), middle, part(part(output, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(part(part(output, PREFIX, 2), MIDDLE, 1), middle, part(part(output, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(transformed: DataFrame) -> DataFrame:
    """The table with output and the text restored from it as SHA-256 of their UTF-8 bytes."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def fill_oracle(seed: int = 7, rate: int = 100, spm: int = 50) -> str:
    """The same in DuckDB's SQL; the text is put back together from the output."""
    h = lambda k: f"('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), {8 * k + 1}, 8))::UBIGINT"
    joined = lambda a, b: f"coalesce(array_to_string(u[{a}:{b}], ''), '')"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, {h(0)} AS h1, {h(1)} AS h2, {h(2)} AS h3, {h(3)} AS h4 FROM documents),
    c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS b,
      CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, {joined(1, "a")} AS p, {joined("a + 1", "b")} AS m, {joined("b + 1", "n")} AS s FROM c),
    o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m END AS output FROM p)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars, sha256(output) AS output_sha256,
      sha256(CASE form WHEN 'plain' THEN output
        WHEN 'psm' THEN split_part(split_part(output, '{SUFFIX}', 1), '{PREFIX}', 2) || split_part(output, '{MIDDLE}', 2) || split_part(split_part(output, '{SUFFIX}', 2), '{MIDDLE}', 1)
        ELSE split_part(split_part(output, '{PREFIX}', 2), '{MIDDLE}', 1) || split_part(output, '{MIDDLE}', 2) || split_part(split_part(output, '{PREFIX}', 1), '{SUFFIX}', 2) END) AS restored_sha256 FROM o"""
