"""Whole-text subword encoding with a per-worker word cache.

A vocabulary whose normaliser and pre-tokeniser throw white space away encodes
every blank-separated word on its own, so a text's ids are the concatenation of
its words' ids.  Words repeat, hence a cache of encoded words replaces most of
the library's work.  Vocabularies without that property take the library's
batch call.  The cache is bounded and never changes results.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct

import numpy as np

#: Entries kept before the cache starts afresh (about 120 MB), unless the encoder's limit says otherwise.
CACHE_WORDS = 500_000
#: Longer words are encoded each time and not kept.
CACHE_WORD_CHARS = 64
#: Letters that NFC leaves alone, then a run of signs; one pre-token each.
SIMPLE_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?*&%$#|]*)")
#: Words on which the direct path must agree with the library before it is used.
PROBES = ("the", "Straße", "Éviter,", "naïve", "thatENING***", "a.", "ñandú;:", "Ÿ", "oficial")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def words_stand_alone(config: dict) -> bool:
    """True if white space only separates words in this vocabulary.

    Needed: a Split that removes what lies between matches, whose pattern has no
    alternative for white space, and a model that marks word ends itself.
    """
    pre = config.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    return bool(
        config["model"].get("type") == "BPE"
        and config["model"].get("end_of_word_suffix")
        and config.get("post_processor") is None
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert")
        and r"\s" not in first["pattern"].get("Regex", r"\s").replace(r"[^\s", "")
        and not any(s.get("add_prefix_space") for s in steps)
        and all(not t.get("lstrip") and not t.get("rstrip") for t in config.get("added_tokens", []))
    )


class WordIds(dict):
    """Ids of words as bytes; a word that isn't there is encoded when it is asked for."""

    def __init__(self, tokenizer, direct: bool):
        super().__init__()
        self.limit = CACHE_WORDS
        self.tokenizer, self.model, self.direct = tokenizer, tokenizer.model, direct
        self.letters, self.signs = byte_letters(), {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > CACHE_WORD_CHARS:
            return self.by_library(word)
        if len(self) >= self.limit:
            self.clear()
        ids = self[word] = self.fresh(word)
        return ids

    def fresh(self, word: str) -> bytes:
        """Ids of a word, encoded now; kept by the caller, if at all."""
        simple = self.direct and len(word) <= CACHE_WORD_CHARS and SIMPLE_WORD.fullmatch(word)
        return self.by_model(*simple.groups()) if simple else self.by_library(word)

    def by_library(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def by_model(self, letters: str, signs: str) -> bytes:
        """Ids of a word that SIMPLE_WORD matches, straight from the model."""
        if letters and signs:
            tail = self.signs.get(signs)
            if tail is None:
                tail = self.by_model("", signs)
                if len(self.signs) < 10_000:
                    self.signs[signs] = tail
            stem = letters.lower()
            ids = self.get(stem)
            if ids is None:
                ids = self.by_model(stem, "")
                if len(self) < self.limit:  # it is likely to come alone, or with other signs
                    self[stem] = ids
            return ids + tail
        piece = letters.lower() or signs
        if not piece:
            return b""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)


class SubwordEncoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: What every special token starts with: texts with it keep their case, in which the tokens are looked for.
        self.opening = os.path.commonprefix([t["content"] for t in config.get("added_tokens", [])])
        self.cached = words_stand_alone(config)
        self.lowers = any(n.get("type") == "Lowercase" for n in (config.get("normalizer") or {}).get("normalizers", []))
        self.words = WordIds(self.tokenizer, False)
        probes = [w for w in PROBES if SIMPLE_WORD.fullmatch(w)]
        self.words.direct = self.lowers and all(self.words.by_model(*SIMPLE_WORD.fullmatch(w).groups()) == self.words.by_library(w) for w in probes)

    def split(self, text: str) -> list[str]:
        """Words that can be encoded one by one, lower-case where that can't matter."""
        if self.lowers and self.opening not in text:
            try:
                text.encode("latin-1")  # beyond, lower case may depend on neighbours
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def forget(self) -> None:
        """Give the cache's memory back."""
        self.words.clear()

    def encode(self, text: str | None) -> bytes:
        """Ids of one whole text (null: none)."""
        if not text:
            return b""
        if not self.cached:
            return self.words.by_library(text)
        return b"".join(map(self.words.__getitem__, self.split(text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> SubwordEncoder:
    """One encoder per Python worker."""
    return SubwordEncoder(path)
