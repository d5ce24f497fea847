"""Token counts that follow edits.

A text is cut into pre-tokens (byte-level BPE never merges across them). A segment tree over leaves of about LEAF
pre-tokens keeps the characters, pre-tokens and tokens of all subtrees; its leaves can be kept in a table, so that later edits
find them there. An edit looks its leaf up from the root and re-reads the text from the last leaf boundary that it cannot
change (REACH characters of context) until a pre-token ends on an old leaf boundary behind the edit; from there on pre-tokens
are the old ones, as the pattern looks ahead only. The new pre-tokens take the place of the touched leaves and the sums above
them are renewed; only where leaves would become too large or too small is the tree built anew from its leaves.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT = regex.compile(PATTERN)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF, REACH, CACHE = 32, 3, 400_000


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Counter:
    """Tokens of a pre-token, remembered up to CACHE entries."""

    def __init__(self, vocabulary: dict[bytes, int]):
        import tiktoken

        self._encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary
        self._known: dict[str, int] = {}

    def __call__(self, piece: str) -> int:
        n = self._known.get(piece)
        if n is None:
            n = len(self._encode(piece))
            if len(self._known) >= CACHE:
                self._known.clear()
            if len(piece) <= 64:
                self._known[piece] = n
        return n


class TokenTree:
    """Leaves (characters, pre-tokens, tokens) and the sums of all subtrees, level by level."""

    def __init__(self, chars: list[int], pieces: list[int], tokens: list[int]):
        self.levels = [[list(chars), list(pieces), list(tokens)]]
        while len(self.levels[-1][0]) > 1:
            self.levels.append([[sum(c[i : i + 2]) for i in range(0, len(c), 2)] for c in self.levels[-1]])

    @classmethod
    def build(cls, text: str, count: Counter) -> TokenTree:
        return cls(*_leaves(SPLIT.findall(text), count, -1))

    @property
    def leaves(self) -> list[list[int]]:
        return self.levels[0]

    @property
    def total(self) -> int:
        return self.levels[-1][2][0] if self.levels[-1][2] else 0

    @property
    def n_pieces(self) -> int:
        return self.levels[-1][1][0] if self.levels[-1][1] else 0

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a place in the text (the last one, if it is behind all), and where it starts; from the root."""
        leaf = start = 0
        for level in reversed(self.levels[:-1]):
            chars = level[0]
            leaf *= 2
            if leaf + 1 < len(chars) and start + chars[leaf] <= at:
                start += chars[leaf]
                leaf += 1
        return leaf, start

    def edit(self, text: str, start: int, end: int, new: str, count: Counter) -> tuple[str, int]:
        """Replaces text[start:end]; returns the new text and how many pre-tokens were encoded again."""
        chars = self.leaves[0]
        changed = text[:start] + new + text[end:]
        if not chars:
            self.__init__(*_leaves(SPLIT.findall(changed), count, -1))
            return changed, self.n_pieces
        shift, behind = len(new) - (end - start), start + len(new)
        first, at = self.find(max(0, start - REACH))
        fresh, last, old_end = [], first, at + chars[first]
        for m in SPLIT.finditer(changed, at):
            fresh.append(m[0])
            while last < len(chars) and (old_end < end or old_end + shift < m.end()):
                last += 1
                old_end += chars[last] if last < len(chars) else 0
            if m.end() >= behind and last < len(chars) and old_end + shift == m.end():
                break
        last = min(last + 1, len(chars))
        spots = last - first
        if fresh and LEAF * spots <= 4 * len(fresh) and len(fresh) <= 2 * LEAF * spots:  # the shape stays
            for column, values in zip(self.leaves, _leaves(fresh, count, spots)):
                column[first:last] = values
            lo, hi = first, last
            for k in range(1, len(self.levels)):
                lo, hi = lo // 2, (hi + 1) // 2
                for column, low in zip(self.levels[k], self.levels[k - 1]):
                    column[lo:hi] = [sum(low[2 * i : 2 * i + 2]) for i in range(lo, hi)]
        else:
            self.__init__(*(c[:first] + v + c[last:] for c, v in zip(self.leaves, _leaves(fresh, count, -1))))
        return changed, len(fresh)


def _leaves(found: list[str], count: Counter, spots: int) -> list[list[int]]:
    """Characters, pre-tokens and tokens of ``spots`` leaves of like size, or of leaves of LEAF pre-tokens (spots -1)."""
    n = len(found)
    cut = list(range(0, n, LEAF)) + [n] if spots < 0 else [n * i // spots for i in range(spots + 1)]
    size = list(map(count, found))
    return [[sum(map(len, found[a:b])) for a, b in zip(cut, cut[1:])], [b - a for a, b in zip(cut, cut[1:])], [sum(size[a:b]) for a, b in zip(cut, cut[1:])]]


def _edited(tree: TokenTree, text: str, changes, count: Counter) -> tuple[str, int]:
    again = 0
    for c in changes or []:
        s = min(max(c["start"] or 0, 0), len(text))
        text, n = tree.edit(text, s, min(max(c["end"] or 0, s), len(text)), c["new"] or "", count)
        again += n
    return text, again


TREE = "doc_id long, text string, chars array<int>, pieces array<int>, tokens array<int>, n_tokens long, reencoded_pieces long"


def _tree_rows(ids, rows) -> pa.RecordBatch:
    leaf = pa.list_(pa.int32())
    cols = [pa.array([t for t, _, _ in rows], pa.string()), *(pa.array([tree.leaves[k] for _, tree, _ in rows], leaf) for k in range(3)), pa.array([tree.total for _, tree, _ in rows], pa.int64()), pa.array([n for _, _, n in rows], pa.int64())]
    return pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "text", "chars", "pieces", "tokens", "n_tokens", "reencoded_pieces"])


def token_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """A table of trees (see TREE) to be written and edited later: one row for each row of ``docs``; null texts are empty. Narrow."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks(vocabulary))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(shipped.value)
        for part in common.slices(frames):
            rows = [(t or "", TokenTree.build(t or "", count)) for t in part.column(1).to_pylist()]
            yield _tree_rows(part.column(0), [(t, tree, tree.n_pieces) for t, tree in rows])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TREE)


def edit_trees(trees: DataFrame, edits, vocabulary: str = VOCABULARY) -> DataFrame:
    """The trees after ``edits`` (see count_edits); reencoded_pieces says how many pre-tokens these edits read again. Narrow."""
    shipped = trees.sparkSession.sparkContext.broadcast(ranks(vocabulary))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(shipped.value)
        for part in common.slices(frames):
            rows = []
            for text, chars, pieces, tokens, changes in zip(*(c.to_pylist() for c in part.columns[1:])):
                tree = TokenTree(chars, pieces, tokens)
                text, again = _edited(tree, text, changes, count)
                rows.append((text, tree, again))
            yield _tree_rows(part.column(0), rows)

    return trees.select("doc_id", "text", "chars", "pieces", "tokens", edits.alias("edits")).mapInArrow(run, TREE)


def count_edits(docs: DataFrame, edits, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pieces, n_tokens, edited_chars, edited_tokens, reencoded_pieces for each row.

    ``edits`` is a column of array<struct<start, end, new>> in code points, applied in order, each to the text as
    the ones before it left it; spans beyond the text are cut to it, nulls are no edits. Null texts count as empty, repeated rows
    give a row each, an empty table none; texts of any length are read whole. Narrow.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(ranks(vocabulary))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(shipped.value)
        for batch in common.slices(frames):
            out: list[list[int]] = [[], [], [], [], []]
            for text, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tree = TokenTree.build(text or "", count)
                out[0].append(tree.n_pieces)
                out[1].append(tree.total)
                text, again = _edited(tree, text or "", changes, count)
                for k, v in enumerate((len(text), tree.total, again)):
                    out[2 + k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], ["doc_id", "n_pieces", "n_tokens", "edited_chars", "edited_tokens", "reencoded_pieces"])

    return docs.select(F.col("doc_id").cast("long"), "text", edits.alias("edits")).mapInArrow(run, "doc_id long, n_pieces long, n_tokens long, edited_chars long, edited_tokens long, reencoded_pieces long")


def sample_edits():
    """Three edits a document: a replaced word in the first quarter, a cut in the middle, an insertion near the end."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    edit = lambda a, b, new: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), new.alias("new"))
    head = F.substring(F.coalesce("text", F.lit("")), 1, 12)
    q = F.floor(n / 4)
    return F.array(edit(q, q + 8, head), edit(q * 2, q * 2 + 5, F.lit("")), edit(q * 3, q * 3, F.concat(F.lit(" "), head, F.lit("'s "))))


def op3(spark, sf_dir: str) -> DataFrame:
    return count_edits(common.table(spark, sf_dir, "documents"), sample_edits())
