"""Whole-text token ids by the tokenizers library, word by word where the tokenizer allows it.

A tokenizer that drops white space before its merges encodes a text as the concatenation of the encodings of
its words. Words repeat, so each distinct word of a batch is encoded once and the ids are gathered by offset.
``WordEncoder`` proves the property on probes when it loads; any other tokenizer encodes whole texts.

Edge cases: null and empty texts, and texts of white space only, have no ids; words of more than 64 characters are encoded
whole and not remembered; no texts give no ids.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .common import split_words

#: Distinct words that one Python worker remembers between batches, and twice as many parts of words, at about 200 bytes
#: each. When there are more words, those of the last batch stay.
MEMO = 100_000
_PROBES = (
    "a b", " a\tb\n", "It's 12 o'clock,\n\n\"quoted\"  text.", "É́a  ßë\r\nÑu\x0b中文 字\f!!", "x|y a|| |b 3.14 's ' s",
    "İΣ ΣΣ é  n  q", "#*$%& *** a$$$ b&&&", "<|im_end|> <b>x</b> <| |>", "🙂🙂 👍🏽 a‍b",
)
#: Words of letters and then marks that need no normaliser but lower case: ASCII and composed Latin letters, ASCII marks.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-;=?-@\[-`{}~]*)")
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    def __init__(self, path: str, most: int = MEMO):
        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.by_word = all(self._whole(p) == self._joined(p) for p in _PROBES)
        self.bytes_of: dict[int, str] | None = None
        self.bytes_of = self._byte_table()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _joined(self, text: str) -> list[int]:
        return [i for w in text.encode().split() for i in self._whole(w.decode())]

    def _byte_table(self) -> dict[int, str] | None:
        """What the tokenizer's byte step makes of each plain letter, if plain words can go straight to its model."""
        step = self.tokenizer.pre_tokenizer
        if not self.by_word or step is None:
            return None
        self.bytes_of = {ord(c): "".join(p for p, _ in step.pre_tokenize_str(c)) for c in _LETTERS}
        marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and _PLAIN.fullmatch("a" + chr(c)))
        probes = [*_LETTERS, *("x" + m for m in marks), "The,", "\u00c9TAT.", "\u00f1and\u00faes!!", "straßE***", "x" + marks, _LETTERS, "don)(", "re-", "internationalisation;", "ÀÖØöøÿ}"]
        same = all(np.frombuffer(self._plain(_PLAIN.fullmatch(p)), np.uint32).tolist() == self._whole(p) for p in probes)
        self.parts = {}
        return self.bytes_of if same else None

    def _part(self, part: str) -> bytes:
        ids = self.parts[part] = np.array([t.id for t in self.tokenizer.model.tokenize(part.translate(self.bytes_of))], np.uint32).tobytes()
        return ids

    def _plain(self, match: re.Match) -> bytes:
        letters, marks = match.groups()
        known = self.parts.get
        ids = known(low := letters.lower()) or self._part(low)
        return ids + (known(marks) or self._part(marks)) if marks else ids

    def _encode_words(self, words: list[str]) -> list[bytes]:
        if len(self.parts) > 2 * self.most:
            self.parts = {}
        out: list[bytes | None] = [None] * len(words)
        if self.bytes_of is not None:
            full, plain = _PLAIN.fullmatch, self._plain
            out = [m and plain(m) for m in map(full, words)]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32).tobytes()
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids as uint32, offsets as int64 with one entry more than texts). A null text has no ids."""
        pa.default_memory_pool().release_unused()  # what the batches before have freed
        if self.by_word:
            return self._by_word(texts)
        encoded = self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        offsets = np.zeros(len(encoded) + 1, np.int64)
        np.cumsum([len(e.ids) for e in encoded], out=offsets[1:])
        return np.concatenate([np.asarray(e.ids, np.uint32) for e in encoded] or [np.empty(0, np.uint32)]), offsets

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, words = split_words(texts)
        if len(words) == 0:
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        distinct = words.dictionary.to_pylist()
        found = list(map(self.words.get, distinct))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = [distinct[i] for i in missing]
            for i, ids in zip(missing, self._encode_words(new), strict=True):
                found[i] = ids
            if len(self.words) + len(missing) > self.most:
                self.words = {w: ids for w, ids in zip(distinct, found, strict=True) if len(w) <= 64}
            else:
                self.words.update((w, found[i]) for i, w in zip(missing, new, strict=True) if len(w) <= 64)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), np.uint32)
        starts = np.cumsum(lengths) - lengths
        index = words.indices.to_numpy(zero_copy_only=False)
        each = lengths[index]
        ends = np.cumsum(each)
        ids = pool[np.repeat(starts[index] - (ends - each), each) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[offsets.to_numpy(zero_copy_only=False)]


@functools.lru_cache(maxsize=2)
def encoder(path: str, most: int = MEMO) -> WordEncoder:
    """One encoder a Python worker, kept while the worker is reused."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path, most)
