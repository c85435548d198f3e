"""Ids of the tokenizers library, faster: merges run by rank in tiktoken, or through tables of distinct chunks."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import LONE_SPACE, ChunkTable, resident

# The byte-level pattern of the tokenizers library, and the word pattern of the vocabulary file over
# lower-case Latin-1 (letters, numbers, other characters that are no white space).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


GUARDED = 20_000  # of each call one text of at most so many characters is encoded by the library, too


class FastTokens:
    """Whole-text ids equal to Tokenizer.encode(text, add_special_tokens=False).ids, as little-endian uint32 bytes.

    Texts in Latin-1 go to tiktoken: the ranks are the merges of the file in their order, an end of word is the byte 0 that
    merges with the letter before it first of all. Other texts, those with byte 0 or with the string of an added token, and
    all texts of a file of another kind go to the tokenizers library. There, what stands between lone spaces (between two
    characters that are no white space) is encoded once per distinct chunk: a lone space always starts a new pre-token of
    the byte-level pattern and is dropped by the word pattern.
    """

    def __init__(self, path: str, fast: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.size = self.tok.get_vocab_size()
        self.tails, self.heads = ChunkTable(lambda x: self._encode([" " + c for c in x])), ChunkTable(self._encode, 20_000)
        self.engine = self._engine(json.load(open(path, encoding="utf-8"))) if fast else None

    def _engine(self, spec: dict):
        import tiktoken

        model, before = spec["model"], json.dumps(spec["pre_tokenizer"])
        end = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or "ByteLevel" not in before or end and json.dumps(WORD_PATTERN) not in before or not end and (spec["normalizer"] or '"use_regex": true' not in before):
            return None
        letters, vocab = byte_letters(), model["vocab"]
        value = {c: b for b, c in enumerate(letters)}

        def raw(token: str) -> bytes:
            whole = bool(end) and token.endswith(end)
            return bytes(value[c] for c in (token[: -len(end)] if whole else token)) + b"\0" * whole

        names = [*letters, *([c + end for c in letters[1:]] if end else [])]
        names += ["".join(m if isinstance(m, list) else m.split(" ")).replace(end or "\0", "") + (end if (m[1] if isinstance(m, list) else m).endswith(end or "\0") else "") for m in model["merges"]]
        ranks = {raw(n): i for i, n in enumerate(names)}
        if len(ranks) != len(names):
            return None
        self.to_id = np.array([vocab.get(n, 0) for n in names], "<u4")
        self.words = re.compile(WORD_LEVEL) if end else None
        return tiktoken.Encoding("merges", pat_str=r"[^\x00]+\x00" if end else BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _quick(self, text: str) -> bytes | None:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if "\0" in text or any(s in text for s in self.special):
            return None
        if self.words:
            text = "\0".join([*self.words.findall(text.lower()), ""])
        return self.to_id[self.engine.encode_ordinary(text)].tobytes() if text else b""

    def ids(self, texts: list[str]) -> list[bytes]:
        out = [self._quick(t) if self.engine else None for t in texts]
        guard = next((i for i in range(len(texts) // 2, len(texts)) if out[i] is not None and len(texts[i]) <= GUARDED), None)
        if guard is not None and self._encode([texts[guard]])[0] != out[guard]:
            raise ValueError(f"ids of a text of {len(texts[guard])} characters differ from the library's")
        left = [i for i, x in enumerate(out) if x is None]
        rows = [[texts[i]] if any(s in texts[i] for s in self.special) else LONE_SPACE.split(texts[i]) for i in left]
        tails = [r[1:] for r in rows]
        tail, head = self.tails.add(tails), self.heads.add([[r[0]] for r in rows])
        for i, r, t in zip(left, rows, tails, strict=True):
            out[i] = head[r[0]] + b"".join(map(tail.__getitem__, t))
        return out


def fast_tokens(path: str) -> FastTokens:
    return resident(("tokens", path), lambda: FastTokens(path))
