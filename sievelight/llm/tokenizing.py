"""Whole-text tokenization with the public vocabulary files; their paths are parameters."""

from __future__ import annotations

import json
import os

import numpy as np

#: Chunks of text whose ids a worker remembers, in each of two generations.
REMEMBER = 400_000
#: The splitter of the vocabulary that is encoded word by word.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PUNCTUATION = b",.!?;:#%&$*|"
_LOWER = bytes(range(256)).lower()


def _splits_at_words(file: dict) -> bool:
    """Whether the parts of a file are those for which texts can be encoded word by word."""
    normal, splitter = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    first = (splitter.get("pretokenizers") or [{}])[0]
    return (
        [n.get("type") for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and normal["normalizers"][1].get("pattern") == {"Regex": r"\s+"} and normal["normalizers"][1].get("content") == " "
        and first.get("pattern") == {"Regex": WORDS} and first.get("behavior") == "Removed" and first.get("invert") is True
        and [p.get("type") for p in splitter["pretokenizers"]] == ["Split", "ByteLevel"]
        and not splitter["pretokenizers"][1].get("use_regex") and not splitter["pretokenizers"][1].get("add_prefix_space") and not file.get("post_processor")
    )


class WordTokenizer:
    """Ids of a ``tokenizers`` file, word by word where its parts allow it, as those of ``word_bpe_49k.json`` do: it lower-cases
    and its splitter never crosses white space or the end of a run of letters. Texts of any other file go to the library whole.

    A text is cut at ASCII white space and the ids of each chunk are remembered, since words recur. The file's normalizer
    and splitter treat the chunks one by one, so the result is that of the whole text. A new chunk that ends in ASCII
    punctuation after a letter is put together from its two parts. Texts with an added token's string in them (which could
    span chunks) go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _splits_at_words(json.loads(self.tokenizer.to_str()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text, as little-endian unsigned 32-bit numbers."""
        text = text or ""
        if not self.by_words or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        chunks = text.encode("utf-8", "replace").translate(_LOWER).split()
        if len(self.known) > REMEMBER:
            self.known, self.older = {}, self.known
        known = self.known
        try:
            return np.frombuffer(b"".join([known[c] for c in chunks]), "<u4")
        except KeyError:
            self._learn({c for c in chunks if c not in known})
            return np.frombuffer(b"".join([known[c] for c in chunks]), "<u4")

    def _learn(self, missing: set[bytes]) -> None:
        known, older = self.known, self.older
        new: set[bytes] = set()
        parted: list[tuple[bytes, bytes, bytes]] = []
        for c in missing:
            if c in older:
                known[c] = older[c]
                continue
            base = c.rstrip(_PUNCTUATION)
            if base and len(base) < len(c) and base.decode()[-1].isalpha():
                end = c[len(base) :]
                parted.append((c, base, end))
                for part in (base, end):
                    if part in older:
                        known[part] = older[part]
                    elif part not in known:
                        new.add(part)
            else:
                new.add(c)
        if new:
            self._encode(list(new))
        for c, base, end in parted:
            known[c] = known[base] + known[end]

    def _encode(self, chunks: list[bytes]) -> None:
        """Encodes new chunks as one text, whose tokens' offsets tell them apart again."""
        words = [c.decode() for c in chunks]
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        encoding = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(encoding.ids, "<u4")
        begins = np.array([o[0] for o in encoding.offsets], np.int64)
        cuts = np.searchsorted(begins, starts).tolist()
        for c, i, j in zip(chunks, cuts, cuts[1:]):
            self.known[c] = ids[i:j].tobytes()


_WORD: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process, kept from task to task."""
    if path not in _WORD:
        _WORD[path] = WordTokenizer(path)
    return _WORD[path]
