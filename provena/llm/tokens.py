"""Token ids of whole texts through the ``tokenizers`` library, with its results kept per word.

The vocabulary lower-cases, drops white space and never merges across it, nor between a letter and a mark that follows it, so
a text's ids are the ids of its words and trailing marks in order. The library encodes each new one once; a bounded table
gives the ids of the others. Words that may hold a special token go to the library whole. Of a vocabulary file with another splitter,
whole texts go to the library.
"""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from provena.llm.common import Words, cut

#: Marks that the vocabulary's splitter cuts off a word's end.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Words made of these characters alone are cut into pieces here; all others go to the library whole.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ž]+")
#: The pieces that the vocabulary file's splitter makes of such a word in lower case. Fixed values of that file.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zßà-öø-ž]+|[0-9]|[^a-zßà-öø-ž0-9]+")
#: What the file says of its splitter and its normalisation where all this holds. Fixed values of that file.
_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]
_KEPT: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes UTF-8 texts to little-endian unsigned 32-bit ids. The table holds ``LIMIT`` words and those of one batch."""

    LIMIT = 400_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        said = json.loads(self.tokenizer.to_str())
        split = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        normal = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        #: whether words and marks have ids of their own
        self.by_word = split == _SPLITTER and normal == _NORMAL and said["model"].get("end_of_word_suffix") == "</w>"

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, new: set[bytes]) -> None:
        """One call for many words: each piece ends with exactly one token that carries the end-of-word mark."""
        keys: list[bytes] = []
        pieces: list[str] = []
        counts: list[int] = []
        for raw in new:
            if raw.isalpha():
                keys.append(raw)
                pieces.append(raw.decode())
                counts.append(1)
                continue
            word = raw.decode()
            if _PLAIN.fullmatch(word) and "<|" not in word:
                parts = _PIECES.findall(word.lower())
                keys.append(raw)
                pieces += parts
                counts.append(len(parts))
            else:
                self.words[raw] = self._ids(word).tobytes()
        if not keys:
            return
        ids = self._ids(" ".join(pieces))
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces):
            for raw in keys:
                self.words[raw] = self._ids(raw.decode()).tobytes()
            return
        data, begin = ids.tobytes(), 0
        for raw, stop in zip(keys, (stops[np.cumsum(counts) - 1] * 4).tolist(), strict=True):
            self.words[raw] = data[begin:stop]
            begin = stop

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts in order, and where each text's ids start (one more for the end)."""
        if not self.by_word:
            every = [self._ids(x.as_py() or "") for x in texts]
            return np.concatenate([np.empty(0, "<u4"), *every]), np.cumsum([0, *map(len, every)])
        was = gc.isenabled()
        gc.disable()  # many small objects and no cycles
        try:
            batch = Words(texts)
            words = batch.distinct.cast(pa.large_string())
            special = pc.match_substring(words, "<|")
            low = pc.if_else(special, words, pc.ascii_lower(words))
            base = pc.ascii_rtrim(low, characters=_MARKS)
            plain = pc.and_not(pc.ascii_is_alpha(base), special)
            heads = pc.if_else(plain, base, low).dictionary_encode()
            tails = pc.if_else(plain, pc.ascii_ltrim(low, characters=_LETTERS), "").dictionary_encode()
            parts = cut(heads.dictionary) + cut(tails.dictionary)
            missing = set(parts) - self.words.keys()
            if len(self.words) + len(missing) > self.LIMIT:
                self.words.clear()
                missing = set(parts)
            missing.discard(b"")
            self._learn(missing)
            self.words[b""] = b""
            own = list(map(self.words.__getitem__, parts))
        finally:
            if was:
                gc.enable()
        index = np.empty(2 * len(batch.index), dtype=np.int64)
        index[0::2] = heads.indices.to_numpy(zero_copy_only=False)[batch.index]
        index[1::2] = tails.indices.to_numpy(zero_copy_only=False)[batch.index] + len(heads.dictionary)
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        flat, at = np.frombuffer(b"".join(own), dtype="<u4"), np.cumsum(sizes) - sizes
        counts = sizes[index]
        ends = np.cumsum(counts)
        ids = flat[np.repeat(at[index] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[2 * batch.starts]


def encoder(path: str) -> WordEncoder:
    """The process's own encoder of a vocabulary file."""
    if path not in _KEPT:
        _KEPT[path] = WordEncoder(path)
    return _KEPT[path]
