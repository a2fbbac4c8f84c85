"""Token ids of texts with a public tokenizer file, inside Spark tasks.

The tokenizer drops white space and never joins characters across it, so the ids of a text
are those of its blank-separated pieces one after the other. A task keeps the ids of pieces
it has met, up to ``CACHE_WORDS``, and asks the tokenizer only for the others.

Most new pieces are a Latin word between signs, which the tokenizer parts from the word. Such
words need no normalising once they are lowered, so many of them go through the tokenizer's
byte-pair model in one text, and the ids that end a word show where the next one begins.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from types import ModuleType

CACHE_WORDS = 1_000_000
#: New words are learned together for texts of so many words, and a longer text in such parts.
GROUP_WORDS = 100_000

#: A lowered Latin word with signs around it. A quote before it could begin a contraction.
_SIGNED_WORD = re.compile(r"([!-&(-/:-@\[-`{-~]*)([a-zªµºß-öø-ɏ]+)([!-/:-@\[-`{-~]*)")


def default_tokenizer() -> str:
    """The file's place, worked out where the task runs."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Little-endian unsigned 32-bit ids of whole texts (as bytes of UTF-8)."""

    def __init__(self, path: str | None = None, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        file = path or default_tokenizer()
        self._tokenizer = Tokenizer.from_file(file)
        self._model = Tokenizer.from_file(file)
        self._model.normalizer = normalizers.Sequence([])
        self._model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(False, use_regex=False)]
        )
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), bool)
        if suffix:
            self._ends[[i for t, i in self._tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self._limit = limit
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def _any(self, words: list[str]) -> list[bytes]:
        import numpy as np

        found = self._tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of lowered Latin words."""
        import numpy as np

        out: list[bytes] = []
        for at in range(0, len(words), GROUP_WORDS):
            part = words[at : at + GROUP_WORDS]
            # without offsets, in half the time
            found = self._model.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(found[0].ids, "<u4")
            cuts = 4 * (np.flatnonzero(self._ends[ids]) + 1)
            if len(cuts) != len(part):
                return self._any(words)
            flat = ids.tobytes()
            begin = 0
            for end in cuts.tolist():
                out.append(flat[begin:end])
                begin = end
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Ids of words that are not known."""
        match = _SIGNED_WORD.fullmatch
        signed, cores, around = [], [], []
        other = []
        bare: list[bytes] = []
        lowered: list[str] = []
        for word in words:
            text = word.decode("utf-8", "replace").lower()
            if text.isalpha() and max(text) < "\u0250":
                bare.append(word)
                lowered.append(text)
            elif (found := match(text)) and "<|" not in text:
                signed.append(word)
                cores.append(found[2])
                around += found[1], found[3]
            else:
                other.append(word)
        known = self._known
        known.update(zip(bare, self._plain(lowered)))
        marks = list(set(around))
        of_mark = dict(zip(marks, self._any(marks)))
        sides = [of_mark[m] for m in around]
        parts = zip(sides[::2], self._plain(cores), sides[1::2])
        known.update(zip(signed, map(b"".join, parts)))
        known.update(zip(other, self._any([w.decode("utf-8", "replace") for w in other])))

    def _ids(self, group: list[list[bytes]]) -> Iterator[bytes]:
        if len(self._known) > self._limit // 2:
            # words met since the last time stay, and older ones that are met again
            self._older, self._known = self._known, {}
        known, older = self._known, self._older
        new = []
        for word in set().union(*group).difference(known):
            if word in older:
                known[word] = older[word]
            else:
                new.append(word)
        if new:
            self._learn(new)
        for part in group:
            yield b"".join(map(known.__getitem__, part))

    def encode_all(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Ids of each text. Learning new words of several texts at once is far quicker."""
        group: list[list[bytes]] = []
        size = 0
        for text in texts:
            words = (text or b"").split()
            if len(words) > GROUP_WORDS:
                yield from self._ids(group)
                group, size = [], 0
                parts = [words[at : at + GROUP_WORDS] for at in range(0, len(words), GROUP_WORDS)]
                yield b"".join(ids for part in parts for ids in self._ids([part]))
                continue
            group.append(words)
            size += len(words)
            if size >= GROUP_WORDS:
                yield from self._ids(group)
                group, size = [], 0
        yield from self._ids(group)

    def encode(self, text: bytes | None) -> bytes:
        return next(self.encode_all([text]))


def encoder(path: str | None = None) -> WordEncoder:
    """One encoder per worker process and file.

    Functions travel by value, so a module variable would live for one task only.
    """
    place = sys.modules.setdefault("_word_encoders", ModuleType("_word_encoders")).__dict__
    return place.setdefault(("encoder", path), None) or _made(place, path)


def _made(place: dict, path: str | None) -> WordEncoder:
    place["encoder", path] = WordEncoder(path)
    return place["encoder", path]
