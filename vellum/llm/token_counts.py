"""Token counts of whole texts, huge ones encoded in overlapping chunks.

A short text is encoded at once. A huge one is encoded in overlapping chunks
with offsets, and the encodings are spliced at common boundaries that are
proven stable: both encodings end a token there, and no piece of the vocabulary
holds the two characters around it side by side. Byte-pair merges join
neighbours only into vocabulary pieces, so no merge can cross such a place,
whatever follows. Where an overlap holds no such place, it is widened, up to
the rest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts up to this length (in code points) are encoded at once; chunks have as many bytes.
CHUNK = 65_536
OVERLAP = 512
LIMIT = 4_096
#: Texts that are encoded at once; bounds the token lists in memory.
GROUP = 128
SPACE = "▁"


class Counter:
    """Counts the tokens of a sentencepiece model file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        #: Splicing needs a normaliser that keeps every character and only marks spaces.
        probe = "Ab  éè ﬁ ①\n\t c"
        self.plain = "".join(self.model.encode_as_pieces(probe)).replace(SPACE, " ") == " " + probe or self._bytes_only(probe)

    def _bytes_only(self, probe: str) -> bool:
        return self.model.decode(self.model.encode(probe)) == probe

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        at_once = [i for i, t in enumerate(texts) if len(t) <= self.chunk or not self.plain]
        for lo in range(0, len(at_once), GROUP):
            part = at_once[lo : lo + GROUP]
            for i, ids in zip(part, self.model.encode([texts[i] for i in part], num_threads=1)):
                out[i] = len(ids)
        for i in set(range(len(texts))).difference(at_once):
            out[i] = self.spliced(texts[i])
        return out

    def ends(self, data: bytes) -> list[int]:
        """Where each token of the UTF-8 text ends, in bytes."""
        return [p.end for p in self.model.encode(data.decode(), return_type="proto").pieces]

    def stable(self, data: bytes, at: int) -> bool:
        """Whether no merge can cross the place before the space at byte ``at``.

        The next chunk starts after that space, whose mark the encoder itself
        puts before a text.
        """
        if data[at] != 0x20 or data[at - 1] == 0x20 or data[at + 1 : at + 2] in (b"", b" "):
            return False
        before = at - 1
        while data[before] & 0xC0 == 0x80:
            before -= 1
        return data[before:at].decode() + SPACE not in self.inside

    def spliced(self, text: str) -> int:
        """Tokens of ``text``, chunk after chunk."""
        data = text.encode()

        def edge(at: int) -> int:
            """The end of a chunk, not inside a character."""
            while at < len(data) and data[at] & 0xC0 == 0x80:
                at += 1
            return min(at, len(data))

        total, start, overlap = 0, 0, self.overlap
        upto = edge(self.chunk)
        ends = self.ends(data[:upto])
        while upto < len(data):
            follow = max(start + 1, upto - overlap)
            here = {start + e: k + 1 for k, e in enumerate(ends)}
            cut = next((p for p in range(follow, upto - 1) if p in here and self.stable(data, p)), None)
            if cut is None and follow > start + 1:
                overlap *= 2  # alignment failed: widen
                continue
            agree = False
            if cut is not None:
                after, further = cut + 1, edge(cut + 1 + self.chunk)
                coming = self.ends(data[after:further])
                # both encode the overlap: up to its last stable place their boundaries have to agree
                last = next((p for p in range(upto - 2, cut, -1) if p in here and self.stable(data, p)), cut)
                agree = sorted(p for p in here if cut < p <= last) == sorted({after + e for e in coming if after + e <= last})
            if agree:
                total += here[cut]
                start, upto, ends, overlap = after, further, coming, self.overlap
            else:  # no common stable place in all of the chunk: encode on to a later end
                upto = edge(upto + max(self.chunk, upto - start))
                ends, overlap = self.ends(data[start:upto]), self.overlap
        return total + len(ends)


@lru_cache(maxsize=4)
def _counter(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


def token_counts(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``.

    ``model`` is the path of a sentencepiece model on every executor. A null
    text counts as empty: no bytes, no tokens. Repeated rows are counted each;
    null ids stay; other columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model, chunk, overlap)
        for batch in batches:
            texts = batch.column(2)
            n: list[int] = []
            for lo in range(0, len(texts), GROUP):
                n += counter.count([t or "" for t in texts.slice(lo, GROUP).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
