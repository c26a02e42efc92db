"""Tokenizer files read once on the driver and shipped to the tasks; exact pre-tokens and ids."""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np
from pyspark.sql import SparkSession

# The byte-level pre-tokenizer's pattern in the terms of Python's re; right for SAFE texts only.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Longer runs of white space overflow the stack of the fast encoder's regex engine.
LONG_SPACE = re.compile(r"(?<!\s)\s{5000}")
# A character outside these ranges may be classed differently by the library's regex engine.
UNSAFE = re.compile(
    "[^\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏΑ-Ρα-ωА-я"
    "‐-‧‰-›ぁ-ゔァ-ヺ一-龥가-힣]"
)


def read_spec(path: str) -> str:
    """A tokenizer file as text, so that tasks need no copy of the file: its kind, then its content."""
    with open(path, "rb") as f:
        data = f.read()
    return "model:" + base64.b64encode(data).decode() if path.endswith(".model") else data.decode("utf-8")


def broadcast_spec(spark: SparkSession, path: str):
    """Broadcasts the file (a few MB whatever the corpus)."""
    return spark.sparkContext.broadcast(read_spec(path))


def _byte_chars() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """One byte-level BPE vocabulary with its special strings."""

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        d = json.loads(spec)
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        chars = _byte_chars()
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.ranks = {bytes(chars[c] for c in t): i for t, i in d["model"]["vocab"].items() if t not in self.special}
        self.tiktoken = tiktoken.Encoding(
            "file", pat_str=_pattern(), mergeable_ranks=self.ranks, special_tokens=self.special
        )
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.back = {c: b for c, b in chars.items()}

    def exact(self, word: bytes) -> list[int]:
        """Exact merging of one pre-token."""
        return self.tiktoken._core_bpe.encode_single_piece(word)

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special string stands alone."""
        if self.split and any(s in text for s in self.special):
            out: list[str] = []
            for x in self.split.split(text):
                out += [x] if x in self.special else self._plain(x)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not UNSAFE.search(text):
            return PRETOKEN.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text as the library gives them."""
        if LONG_SPACE.search(text):
            pieces = ([self.special[x]] if x in self.special else self.exact(x.encode()) for x in self.pretokens(text))
            return np.array([i for own in pieces for i in own], np.uint32)
        if not UNSAFE.search(text):
            return self.tiktoken.encode_to_numpy(text, allowed_special="all")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def _pattern() -> str:
    # fixed value: the published pattern of the byte-level pre-tokenizer
    return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def is_byte_level(spec: str) -> bool:
    """Whether pre-token work is exact: byte-level BPE, nothing that rewrites or adds."""
    if spec.startswith("model:"):
        return False
    d = json.loads(spec)
    pre, model = d.get("pre_tokenizer") or {}, d["model"]
    plain = not d.get("normalizer") and not d.get("post_processor") and model.get("type") == "BPE"
    own = not any(t.get(k) for t in d["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    return bool(
        plain and own and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        and not pre.get("add_prefix_space") and not model.get("dropout") and not model.get("byte_fallback")
    )


@functools.lru_cache(maxsize=2)
def byte_level(spec: str) -> ByteLevel:
    """One vocabulary object a worker."""
    return ByteLevel(spec)


@functools.lru_cache(maxsize=2)
def library_counter(spec: str):
    """A function from texts to token counts, for vocabularies without the pre-token way."""
    if spec.startswith("model:"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=base64.b64decode(spec[6:]))
        return lambda texts: [len(x) for x in sp.encode(list(texts), num_threads=1)] if texts else []
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x.ids) for x in t.encode_batch(list(texts), add_special_tokens=False)]
