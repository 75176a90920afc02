"""Token counts with overlap resynchronisation.

A huge document is cut into chunks that overlap.  Each chunk is encoded alone, and its tokens' offsets
come from the lengths of the pieces.  Two neighbours are spliced at a boundary that both have inside
their overlap and that is proven stable: two characters that stand side by side in no piece of the vocabulary, as a
letter and a space, or most pairs of ideographs.  What a merge makes is a piece, so no merge can cross such a place, and what
follows it is encoded alike whatever came before.  Where an overlap holds no such boundary it is doubled, up to the
whole rest of the text (one letter repeated without end has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadentia.llm.common import slices, texts, utf8

CHUNK_BYTES = 65_536
OVERLAP_BYTES = 256
LIMIT = 4096


class Pieces:
    """A piece model with the lengths of its pieces and the pairs of characters that stand in them."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        # In a piece "▁" stands for one space; a byte piece for one byte.
        self.lengths = np.array([1 if self.model.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in enumerate(names)])
        self.unknown = self.model.unk_id()
        ordinary = (p.replace("▁", " ") for i, p in enumerate(names) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)))
        self.pairs = {pair for p in ordinary for pair in zip(p, p[1:])}
        plain = ["a", " a", "a  b ", "\t\n", "ﬁé́"]
        self.provable = all(self.model.decode(self.model.encode(x)) == x for x in plain)

    def stable(self, data: bytes, at: int) -> bool:
        """Whether no piece reaches across the start of a character at `at`."""
        before = _boundary(data, at - 1, -1)
        return (data[before:at].decode(), data[at : _boundary(data, at + 1, 1)].decode()) not in self.pairs

    def encode(self, chunk: bytes, first: bool) -> tuple[np.ndarray, bool]:
        """Offsets in bytes at which tokens begin in a chunk, -1 for the space that is put before it; and
        whether the lengths add up (an unknown piece has no length of its own)."""
        ids = np.array(self.model.encode(chunk.decode()), dtype=np.int64)
        ends = np.cumsum(self.lengths[ids]) - 1
        return np.concatenate([[-1], ends[:-1]]), bool(len(ids)) and ends[-1] == len(chunk) and not (ids == self.unknown).any()

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


def _boundary(data: bytes, at: int, step: int) -> int:
    """The nearest start of a character."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += step
    return at


def spliced_count(pieces: Pieces, data: bytes, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> int:
    """Tokens of a document, chunk by chunk."""
    if len(data) <= chunk or not pieces.provable or "▁".encode() in data:
        return pieces.count([data.decode()])[0]
    total, low, since = 0, 0, -1  # tokens that begin at or after `since` and before the splice are counted
    high = _boundary(data, chunk, 1)
    left, fine = pieces.encode(data[:high], True)
    if not fine:
        return pieces.count([data.decode()])[0]
    while high < len(data):
        width, spliced = overlap, None
        while spliced is None:
            begin = max(_boundary(data, high - width, -1), low)
            end = _boundary(data, min(len(data), begin + max(chunk, 2 * width)), 1)
            right, fine = pieces.encode(data[begin:end], False)
            if not fine:
                return pieces.count([data.decode()])[0]
            common = np.intersect1d(left + low, right + begin)
            inside = (int(b) for b in common[::-1] if max(begin, since) < b < high and data[b] & 0xC0 != 0x80)
            spliced = next((b for b in inside if pieces.stable(data, b)), None)
            if spliced is not None:
                pass
            elif begin == low:  # the overlap is the whole chunk: make the chunk itself longer
                high = _boundary(data, min(len(data), high + chunk), 1)
                left, fine = pieces.encode(data[low:high], low == 0)
                if not fine:
                    return pieces.count([data.decode()])[0]
                if high == len(data):
                    break
                chunk = 2 * chunk
            else:
                width = 2 * width
        if spliced is None:
            break
        total += int(((left + low >= since) & (left + low < spliced)).sum())
        low, high, left, since = begin, end, right, spliced
    return total + int((left + low >= since).sum())


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    Null and empty texts have no bytes and no tokens.  Special strings in a text are ordinary text, and
    nothing is added or cut.  Repeated rows are counted each; other columns are not read; an empty table
    gives an empty result.  The model's file must be at `model_path` on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_path)
        for batch in batches:
            at, data = utf8(batch.column("text"))
            sizes, counts = np.diff(at), np.zeros(len(at) - 1, np.int64)
            for low, high in slices(at):
                short: dict[str, list[int]] = {}
                for i in range(low, high):
                    own = data[at[i] : at[i + 1]].tobytes()
                    if len(own) > chunk:
                        counts[i] = spliced_count(pieces, own, chunk, overlap)
                    elif own:
                        short.setdefault(own.decode(), []).append(i)
                for n, rows in zip(pieces.count(list(short)), short.values(), strict=True):
                    counts[rows] = n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
