"""Edit-aware token counts.

A document's text is cut at places where a pre-token surely starts (a single space between two other characters). Leaves are
runs of such pieces; a segment tree over the leaves holds characters and tokens of every subtree. An edit re-encodes only the
leaves that it touches, with a neighbouring leaf where it comes within `CONTEXT` characters of a border, and then mends the
sums on the paths to the root. The count is the same as that of encoding the edited text anew.

Defined cases: null and empty texts are one empty leaf with no tokens; an edit that starts behind the end appends, a length
beyond the end is cut to it, null starts and lengths count as 0 and null replacements as empty, and a null list of edits is
none; edits are applied in order, each to the text that those before it left; repeated rows are counted each; an empty table
gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import columns_of, map_batches
from skein.llm.tokens import ChunkEncoder, chunks, encoder
from skein.session import ship

#: Pieces in a leaf, and characters at either side of a border that an edit may not touch without the leaf beyond it.
LEAF, CONTEXT = 48, 3


def count(enc: ChunkEncoder, text: str) -> int:
    return len(enc.encode([text])[0]) // 4


class SegmentTree:
    """Sums of (characters, tokens) over leaves, as heaps: node i has the children 2i and 2i+1, leaf j is node width+j."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.n, self.width = len(chars), 1 << max(0, (len(chars) - 1).bit_length())
        pad = [0] * (self.width - self.n)
        self.chars = [0] * self.width + chars + pad
        self.tokens = [0] * self.width + tokens + pad
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaf_at(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character pos (the last filled one for the end of the text), and where it starts."""
        if not self.chars[1]:
            return 0, 0
        i, start = 1, 0
        pos = min(pos, max(0, self.chars[1] - 1))
        while i < self.width:
            i *= 2
            if pos - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.width
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]


def build(enc: ChunkEncoder, text: str) -> SegmentTree:
    parts = chunks(text)
    if missing := set(parts[1:]).difference(enc.later):
        enc._learn(enc.later, list(missing), " ")  # a whole document's new pieces at once
    chars, tokens = [], []
    for at in range(0, len(parts), LEAF):
        leaf = " ".join(parts[at : at + LEAF])
        raw = ("" if at == 0 else " ") + leaf
        chars.append(len(raw))
        tokens.append(sum(map(len, _counts(enc, parts[at : at + LEAF], at == 0))) // 4)
    return SegmentTree(chars, tokens)


def _counts(enc: ChunkEncoder, parts: list[str], first: bool) -> list[bytes]:
    """Ids of the pieces, of which all but the text's first have a leading space."""
    head = [enc.encode([parts[0]])[0]] if first else []
    rest = parts[1:] if first else parts
    try:
        return head + list(map(enc.later.__getitem__, rest))
    except KeyError:
        enc._learn(enc.later, list({r for r in rest if r not in enc.later}), " ")
        return head + list(map(enc.later.__getitem__, rest))


def edit(enc: ChunkEncoder, tree: SegmentTree, text: str, start: int, length: int, new: str) -> tuple[str, int]:
    """The edited text and how many characters were encoded again; the tree is changed in place."""
    start = min(max(0, start), len(text))
    end = min(len(text), start + max(0, length))
    a, a0 = tree.leaf_at(max(0, start - CONTEXT))
    b, b0 = tree.leaf_at(min(len(text), end + CONTEXT))
    b1 = b0 + tree.chars[b + tree.width]
    again = text[a0:start] + new + text[end:b1]
    for leaf in range(a + 1, b + 1):
        if tree.chars[leaf + tree.width]:
            tree.set(leaf, 0, 0)
    tree.set(a, len(again), count(enc, again))
    return text[:start] + new + text[end:], len(again)


def build_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The columns of docs with leaf_chars and leaf_tokens, from which a document's tree is made again."""
    ship(docs.sparkSession)
    keep = docs.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(tokenizer)
        trees = [build(enc, t.as_py() or "") for t in b.column("text")]
        leaves = [pa.array([getattr(t, k)[t.width : t.width + t.n] for t in trees], pa.list_(pa.int32())) for k in ("chars", "tokens")]
        return pa.RecordBatch.from_arrays([*b.columns, *leaves], [*keep, "leaf_chars", "leaf_tokens"])

    return map_batches(docs, run, f"{columns_of(docs)}, leaf_chars array<int>, leaf_tokens array<int>", "tokens")


def apply_edits(trees: DataFrame, tokenizer: str, text: bool = False) -> DataFrame:
    """Applies the column edits, array<struct<start:int,length:int,replacement:string>>, to rows of build_trees(): doc_id,
    n_tokens, edited_tokens, encoded_chars (those encoded again), n_leaves, and the new leaves (and text)."""
    ship(trees.sparkSession)
    names = ["doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "encoded_chars", "n_leaves", "leaf_chars", "leaf_tokens", "text"][: 9 + text]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc, rows = encoder(tokenizer), []
        for doc, t, edits, chars, tokens in zip(*(b.column(c) for c in ("doc_id", "text", "edits", "leaf_chars", "leaf_tokens")), strict=True):
            now, tree, again = t.as_py() or "", SegmentTree(chars.as_py(), tokens.as_py()), 0
            was = tree.chars[1], tree.tokens[1]
            for e in edits.as_py() or ():
                if e is not None:
                    now, k = edit(enc, tree, now, e["start"] or 0, e["length"] or 0, e["replacement"] or "")
                    again += k
            w = tree.width
            rows.append((doc.as_py(), *was, tree.chars[1], tree.tokens[1], again, tree.n, tree.chars[w : w + tree.n], tree.tokens[w : w + tree.n], now)[: 9 + text])
        types = (*[pa.int64()] * 7, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    schema = ", ".join(f"{c} long" for c in names[:7]) + ", leaf_chars array<int>, leaf_tokens array<int>" + ", text string" * text
    return map_batches(trees.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits", "leaf_chars", "leaf_tokens"), run, schema, "tokens")


def sample_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text and three edits of each document, made of its own text: a cut near the start, a swap, an insertion near the end."""
    n, t = F.length("text"), F.col("text")
    at = lambda share: F.floor(n * share).cast("int")
    one = lambda a, b, c: F.struct(a.alias("start"), b.alias("length"), c.alias("replacement"))
    edits = F.array(
        one(at(0.1), F.least(F.lit(17), at(0.1)), F.lit("")),
        one(at(0.5), F.lit(5), F.reverse(F.substring(t, 1, 12))),
        one(at(0.8), F.lit(0), F.concat(F.lit(" "), F.substring(t, 3, 40))),
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(t, F.lit("")).alias("text")).withColumn("edits", edits)
