"""Fill-in-the-middle forms of texts, by a pipeline of Arrow kernels over each batch.

A text is cut into units (lines with their line feed). The units of all texts of a batch stand in one list array; it is
flattened with the index of each unit's text, units get their ordinal in it, are filtered by role (prefix, middle, suffix),
made into lists again and joined. Where a text is cut depends on its doc_id alone, so a task that runs again gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are rewritten, and of 100 of these so many in the order suffix, prefix, middle.
FIM_RATE, SPM_RATE, SEED = 100, 50, 7
#: Bytes of text that are handled at once (one text at least).
BATCH_BYTES = 8 << 20


def by_bytes(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of its text column."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The units of all texts in one array, the index of each one's text, its ordinal there, and the texts' counts."""
    pieces = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(pieces), pc.list_parent_indices(pieces).to_numpy()
    start = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    ordinal = np.arange(len(flat)) - start[parent]
    last = ordinal == np.diff(start)[parent] - 1
    unit = pc.binary_join_element_wise(flat, pc.if_else(pa.array(last), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())), pa.scalar("", pa.large_string()))
    some = pc.greater(pc.binary_length(unit), 0)  # behind the last line feed stands nothing
    keep = some.to_numpy(zero_copy_only=False)
    return unit.filter(some), parent[keep], ordinal[keep], np.bincount(parent[keep], minlength=len(texts))


def joined(unit: pa.Array, parent: np.ndarray, role: np.ndarray, rows: int) -> pa.Array:
    """For each of ``rows`` texts its units where ``role``, as one text."""
    offsets = np.r_[0, np.cumsum(np.bincount(parent[role], minlength=rows))]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), unit.filter(pa.array(role))), pa.scalar("", pa.large_string()))


def _glued(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts), pa.scalar("", pa.large_string()))


def restore(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that these outputs were made of."""

    def cut(a: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
        two = pc.split_pattern(a, mark, max_splits=1)
        return pc.list_element(two, 0), pc.list_element(two, 1)

    parts, rows = [], []
    for kind, first, second in (("plain", "", ""), ("psm", PREFIX, SUFFIX), ("spm", SUFFIX, PREFIX)):
        at = np.flatnonzero(pc.equal(form, kind).to_numpy(zero_copy_only=False))
        some = output.take(pa.array(at))
        if kind != "plain" and len(at):
            head, middle = cut(some, MIDDLE)
            one, two = cut(cut(head, first)[1], second)
            some = _glued(one, middle, two) if kind == "psm" else _glued(two, middle, one)
        parts.append(some)
        rows.append(at)
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(rows), kind="stable")))


def transform(texts: pa.Array, h: list[np.ndarray], fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text; ``h``: four numbers for each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    rows = len(texts)
    unit, parent, ordinal, n = units(texts)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    role = (ordinal >= np.minimum(one, two)[parent]).astype(np.int8) + (ordinal >= np.maximum(one, two)[parent])
    prefix, middle, suffix = (joined(unit, parent, role == r, rows) for r in range(3))
    plain = pc.equal(pc.binary_length(texts), 0)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    plain = pc.or_(plain, pa.array(h[2] % 100 >= fim_rate))
    spm = pa.array(h[3] % 100 < spm_rate)
    output = pc.if_else(plain, texts, pc.if_else(spm, _glued(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), _glued(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return {"n": pa.array(n.astype(np.int64)), "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")), "prefix_chars": chars[0], "middle_chars": chars[1], "output": output}


def fill_in_middle(docs: DataFrame, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """For each row: doc_id, n (lines), form, prefix_chars, middle_chars, output, and restored (read back from output and form).

    Null and empty texts give n = 0 and an empty plain output; a null doc_id counts as empty text; rows that repeat give the
    same row again; an empty table gives none. Other columns, whatever their names, are not looked at. Nothing is shuffled;
    a task holds about BATCH_BYTES of texts, or one text.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for part in by_bytes(batch, 1):
                out = transform(part.column(1), [part.column(2 + k).to_numpy(zero_copy_only=False) for k in range(4)], fim_rate, spm_rate)
                out["restored"] = restore(out["output"], out["form"])
                yield pa.RecordBatch.from_arrays([part.column(0), *(a.cast(pa.string()) if pa.types.is_large_string(a.type) else a for a in out.values())], ["doc_id", *out])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", *numbers).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


def op12(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(common.table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_OP12 = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), places AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d FROM cut
), parts AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 100 THEN 'plain' WHEN d < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS s
  FROM places
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
