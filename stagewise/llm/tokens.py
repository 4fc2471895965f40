"""Token ids by a fixed vocabulary, with a bounded memo of text segments."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache
from itertools import islice

import numpy as np

#: A single space between non-spaces always starts a new pre-token of the byte-level
#: pattern, and what stands before or after it does not change how the rest is cut.
_EDGE = re.compile(r"(?<!\s) (?!\s)")
_DIRTY = re.compile(r"\s\s")
MEMO = 500_000
#: Pre-token pattern of the byte-level tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings and ids, if the vocabulary is a byte-level one whose ids follow its merges."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    before = told.get("pre_tokenizer") or {}
    plain = not told.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or told["model"].get("type") != "BPE" or told["model"].get("unk_token") or told["model"].get("ignore_merges"):
        return None
    # bytes that print stand for themselves, the others for characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in told["added_tokens"]}
    ids = {t: i for t, i in told["model"]["vocab"].items() if t not in special}
    merged = [ids.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in told["model"]["merges"]]
    if merged != sorted(merged) or min(merged, default=0) < 0:
        return None
    return {bytes(byte[c] for c in t): i for t, i in ids.items()}


class _Memo(dict):
    """Ids of a segment that follows a space, encoded when first asked for."""

    def __init__(self, encode, known=()):
        super().__init__(known)
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        out = self.encode(" " + part)
        if len(part) <= 64:
            self[part] = out
        return out


class Encoder:
    """Encodes texts as the library does, looking up segments already seen.

    The memo holds MEMO segments of at most 64 characters and those of one batch; when
    it is full the younger half goes, as frequent segments come early. Latin segments
    go through the byte-pair ranks of the same vocabulary, where it has such; all
    others, and texts that hold a special string, through the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.fast = None
        if ranks := _ranks(path):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memo = _Memo(self._segment)

    def _library(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _segment(self, part: str) -> bytes:
        if self.fast and (part.isascii() or max(part) < "ɐ"):
            return array(self.code, self.fast(part)).tobytes()
        return self._library(part)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of `type`."""
        out = []
        for text in batch:
            if any(s in text for s in self.special):
                out.append(self._library(text))
                continue
            if len(self.memo) > MEMO:
                self.memo = _Memo(self._segment, islice(self.memo.items(), MEMO // 2))
            parts = _EDGE.split(text) if _DIRTY.search(text) or text[-1:].isspace() else text.split(" ")
            out.append((self._segment(parts[0]) if parts[0] else b"") + b"".join(map(self.memo.__getitem__, islice(parts, 1, None))))
        return out


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)
