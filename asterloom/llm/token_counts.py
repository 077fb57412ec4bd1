"""Edit-aware token counts.

A document is cut into leaves at places where the tokenizer's pre-tokens always
begin, whatever stands elsewhere: single spaces between characters that are no
white space.  So a text's tokens are its leaves' tokens.  A segment tree over
the leaves holds their counts.  An edit re-encodes the leaves it touches; if it
makes a cut at their edge unsafe, the leaf beyond joins in.  Then the sums above
them are updated, and the root is the document's count.

Trees are kept: ``counted`` encodes every text once and gives a table of texts
with their trees (sums of characters and tokens, root first), which is
written.  ``edited`` applies edits to rows of such a table, encodes what they
touch only, and gives the next state of the rows with texts and trees.

Edits (start, end, text) are in code points of the text as earlier edits left
it; bounds outside the text are moved to its ends, and an end before its start
counts as the start.  A null text is empty, null edits are none, a null
replacement is empty.  Rows that repeat a document are counted each.  An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import encoder

#: Characters of a leaf, about.
LEAF = 512


def _is_cut(text: str, at: int) -> bool:
    """Whether a pre-token begins at ``at`` for certain."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def _cut(text: str, size: int = LEAF) -> list[str]:
    leaves, start, at = [], 0, size
    while at < len(text):
        at = text.find(" ", at)
        if at < 0:
            break
        if _is_cut(text, at):
            leaves.append(text[start:at])
            start, at = at, at + size
        else:
            at += 1
    return [*leaves, text[start:]]


class CountedText:
    """A text as leaves under a segment tree of characters and tokens."""

    def __init__(self, text: str, count: Callable[[str], int]):
        self.count = count
        self.encoded = 0
        self.leaves = _cut(text)
        self._build([self._measure(x) for x in self.leaves])

    @classmethod
    def kept(cls, text: str, chars: np.ndarray, tokens: np.ndarray, count: Callable[[str], int]) -> CountedText:
        """The text under a tree that was kept: nothing is encoded."""
        doc = cls.__new__(cls)
        doc.count, doc.encoded = count, 0
        doc.tree = np.stack([chars, tokens], 1).astype(np.int64)
        doc.width = len(doc.tree) // 2
        sizes = doc.tree[doc.width :, 0]
        ends = np.cumsum(sizes[: max(1, int((sizes > 0).sum()))])  # only the single leaf of an empty text is empty
        doc.leaves = [text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return doc

    def _measure(self, leaf: str) -> tuple[int, int]:
        self.encoded += len(leaf)
        return len(leaf), self.count(leaf)

    def _build(self, sums: list[tuple[int, int]]) -> None:
        self.width = 1 << max(0, (len(sums) - 1).bit_length())
        self.tree = np.zeros((2 * self.width, 2), np.int64)
        self.tree[self.width : self.width + len(sums)] = sums
        for i in range(self.width - 1, 0, -1):
            self.tree[i] = self.tree[2 * i] + self.tree[2 * i + 1]

    @property
    def tokens(self) -> int:
        return int(self.tree[1, 1])

    @property
    def length(self) -> int:
        return int(self.tree[1, 0])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position (the last one for the end), and where it starts."""
        i, start = 1, 0
        while i < self.width:
            left = int(self.tree[2 * i, 0])
            i, start = (2 * i, start) if position < start + left else (2 * i + 1, start + left)
        leaf = min(i - self.width, len(self.leaves) - 1)
        return (leaf, start) if leaf == i - self.width else (leaf, self.length - len(self.leaves[leaf]))

    def edit(self, start: int, end: int, text: str) -> None:
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        a, at = self._leaf_at(start)
        b, to = self._leaf_at(end)
        new = self.leaves[a][: start - at] + text + self.leaves[b][end - to :]
        # Boundary context: a cut is kept only while it is safe with what now stands on both sides.
        while a > 0 and not (new and _is_cut(self.leaves[a - 1][-1] + new[:2], 1)):
            a -= 1
            new = self.leaves[a] + new
        while b < len(self.leaves) - 1 and not (new and _is_cut(new[-1] + self.leaves[b + 1][:2], 1)):
            b += 1
            new += self.leaves[b]
        if a == b and len(new) < 4 * LEAF:
            self.leaves[a] = new
            i = a + self.width
            self.tree[i] = self._measure(new)
            while i > 1:
                i //= 2
                self.tree[i] = self.tree[2 * i] + self.tree[2 * i + 1]
            return
        # The number of leaves changes: other leaves keep their sums, only the new ones are encoded.
        fresh = _cut(new)
        sums = [tuple(x) for x in self.tree[self.width : self.width + len(self.leaves)]]
        self.leaves[a : b + 1] = fresh
        self._build([*sums[:a], *map(self._measure, fresh), *sums[b + 1 :]])


_TREE = "text string, chars array<long>, tokens array<long>"


def _row(doc: CountedText | None) -> tuple[str | None, np.ndarray | None, np.ndarray | None]:
    return (None, None, None) if doc is None else (doc.text, doc.tree[:, 0].copy(), doc.tree[:, 1].copy())


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]


def counted(docs: DataFrame, *, doc_id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id, text, chars, tokens of ``docs`` (doc_id, text): each text with its tree, to be written; a null text has no tree."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows = [_row(None if text.as_py() is None else CountedText(text.as_py(), lambda s: len(encode(s)))) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows)], ["doc_id", "text", "chars", "tokens"])

    return docs.select(doc_id, "text").mapInArrow(run, f"doc_id {kind}, {_TREE}")


def edited(trees: DataFrame, *, edits: str = "edits", vocabulary: str | None = None) -> DataFrame:
    """doc_id, text, chars, tokens after the edits, n_tokens, n_tokens_edited, n_chars_encoded_again of ``trees`` (as ``counted`` gives, and edits)."""
    kind = trees.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows, out = [], []
            for text, chars, tokens, changes in zip(*batch.columns[1:]):
                changes = changes.as_py() or ()
                count = lambda s: len(encode(s))
                if text.as_py() is None:
                    doc = CountedText("", count)
                else:
                    doc = CountedText.kept(text.as_py(), chars.values.to_numpy(), tokens.values.to_numpy(), count)
                before, encoded = doc.tokens, doc.encoded
                for e in changes:
                    doc.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                rows.append(_row(doc if changes or text.as_py() is not None else None))
                out.append((before, doc.tokens, doc.encoded - encoded))
            counts = (pa.array([r[i] for r in out], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows), *counts], ["doc_id", "text", "chars", "tokens", "n_tokens", "n_tokens_edited", "n_chars_encoded_again"])

    return trees.select("doc_id", "text", "chars", "tokens", edits).mapInArrow(run, f"doc_id {kind}, {_TREE}, n_tokens long, n_tokens_edited long, n_chars_encoded_again long")
