"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the model has a mark (the escaped space) behind another character, so a boundary between a character and the
mark that follows it is never crossed by a merge: each marked word has the same pieces wherever it stands. `crossing`
proves this for a model; for one that fails the proof whole texts are encoded instead.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import ChunkTable, column, resident, slices, texts_of, trimmed

MARK = "▁"
GUARDED = 20_000  # of each batch one whole text of at most so many characters is encoded and decoded by the library, too
LONE_MARK = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def crossing(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether a piece holds a mark behind another character, or the model alters spaces or has pieces matched as wholes."""
    inner = any(re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in range(model.vocab_size()))
    probe = ["a  b", " a", "a ", "  ", "x\n y"]
    return inner or any(model.decode(model.encode(p)) != p for p in probe) or model.encode("a", out_type=str) != [MARK + "a"]


class Codec:
    """encode and decode of whole texts with one model file; loaded once a process."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = crossing(self.model)
        self.starts = np.array([self.model.id_to_piece(i).startswith(MARK) for i in range(self.model.vocab_size())])
        self.table = ChunkTable(self._segment)

    def _segment(self, chunks: list[str]) -> list[tuple[str, int, str]]:
        """Ids as text, their number and the decoded text of each chunk; plain chunks go to the library joined in one text."""
        plain = [not self.whole and bool(c) and " " not in c and MARK not in c for c in chunks]
        easy = [c for c, p in zip(chunks, plain, strict=True) if p]
        found: list[tuple[str, int, str]] = []
        for i in range(0, len(easy), 4096):
            part = easy[i : i + 4096]
            ids = self.model.encode(text := " ".join(part))
            cuts = [*np.flatnonzero(self.starts[ids]).tolist(), len(ids)]
            same = self.model.decode(ids) == text
            if len(cuts) != len(part) + 1:
                raise ValueError("joined chunks can't be parted")
            says = list(map(str, ids))
            found += [(" ".join(says[a:b]), b - a, c if same else self.model.decode(ids[a:b])) for a, b, c in zip(cuts[:-1], cuts[1:], part, strict=True)]
        hard = self.model.encode([c for c, p in zip(chunks, plain, strict=True) if not p], num_threads=1)
        simple, rest = iter(found), iter([(" ".join(map(str, x)), len(x), self.model.decode(x)) for x in hard])
        return [next(simple if p else rest) for p in plain]

    def parts(self, text: str) -> list[str]:
        return [text] if self.whole or not text else LONE_MARK.split(text)

    def ids(self, text: str) -> list[int]:
        known = self.table.add([parts := self.parts(text)])
        return [int(i) for p in parts for i in known[p][0].split()] + [self.model.eos_id()]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(ids with the end id, sha256 of the ids, sha256 of the decoded text) of each text."""
        rows, end = [self.parts(t) for t in texts], str(self.model.eos_id())
        known = self.table.add(rows)
        guard = next((i for i in range(len(texts) // 2, len(texts)) if len(texts[i]) <= GUARDED), None)
        for i, row in enumerate(rows):
            found = [known[p] for p in row]
            ids = " ".join([x[0] for x in found if x[1]] + [end])
            text = " ".join([x[2] for x in found])
            if i == guard and (ids.split() != [*map(str, self.model.encode(texts[i])), end] or text != self.model.decode(list(map(int, ids.split())))):
                raise ValueError(f"pieces of a text of {len(texts[i])} characters differ from the library's")
            yield sum([x[1] for x in found]) + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def codec(path: str) -> Codec:
    return resident(("codec", path), lambda: Codec(path))


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has the end id alone and decodes to the empty text; a null doc_id stays null; repeated rows give
    repeated rows; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for a, b in slices(texts):
                n, i, d = zip(*own.digests([t or "" for t in texts.slice(a, b - a).to_pylist()]), strict=True)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(i), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), SCHEMA)
