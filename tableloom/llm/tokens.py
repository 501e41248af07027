"""Token ids of whole texts by the tokenizers library, with a bounded cache of parts.

The byte-level pre-tokenizer never lets a piece reach across the border between a character
that is no white space and a following space or line break. So a text may be cut there
and the parts encoded one by one; parts are mostly words, and most words return. Parts
seen first are encoded by the library, many in one call, and the ids are told apart by
their lengths in bytes. Texts that hold one of the vocabulary's added tokens, such as
``<|endoftext|>``, are encoded whole, which gives these the ids the library gives them.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterable, Sequence
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space other than the space and the line break; the first four may or may not count.
_DOUBTFUL = "\x1c\x1d\x1e\x1f"
_ODD = _DOUBTFUL + "\t\v\f\r\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
_CHUNK = re.compile(r"\s*\S+|\s+")


def _even(text: str) -> bool:
    """Whether single spaces and single line breaks are all the white space there is."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in " \n" or text[-1:] in " \n":
        return False
    return not any(c in text for c in (_ODD[:8] if text.isascii() else _ODD))


class Encoder:
    """Encodes batches of texts; ``cached`` bounds the number of parts kept."""

    def __init__(self, path: str, cached: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts with one of these go to the library whole, as it cuts them out before anything else.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        # Byte-level tokens are spelled with one character per byte.
        self.n_bytes = np.zeros(size, np.int64)
        for token, number in vocabulary.items():
            self.n_bytes[number] = len(token)
        self.cached = cached
        # Ids of parts as they stand, and of words with the space before them. Words that
        # have not returned since the last turnover are forgotten at the next.
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks = dict(zip(".,", self._ids([".", ","])))

    def _ids(self, texts: Sequence[str]) -> Iterable[bytes]:
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(found.ids, self.kind).tobytes()

    def _learn_words(self, new: list[str]) -> None:
        """Words without white space and parts that begin with a line break.

        A full stop or comma after a Latin letter is a piece of its own, so the word without
        it is learnt, which serves for all its forms.
        """
        words = self.words
        ending = [w for w in new if w[-1] in ".," and w[-2:-1].isalpha() and w[-2] < "\u0250"]
        stems = {w[:-1] for w in ending}
        plain = {w for w in new if w not in words}.difference(ending) | {s for s in stems if s not in words}
        self._encode_words(list(plain))
        for word in ending:
            words[word] = words[word[:-1]] + self.marks[word[-1]]

    def _encode_words(self, new: list[str]) -> None:
        for start in range(0, len(new), 256):
            part = new[start : start + 256]
            spelled = [w if w[0] == "\n" else " " + w for w in part]
            joined = "".join(spelled)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind)
            ends = np.cumsum(list(map(len, spelled if joined.isascii() else map(str.encode, spelled))))
            cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1
            data, before = ids.tobytes(), 0
            for word, cut in zip(part, (cuts * ids.itemsize).tolist()):
                self.words[word] = data[before:cut]
                before = cut

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text."""
        whole = {i: t for i, t in enumerate(texts) if any(a in t for a in self.added)}
        if not whole:
            return self._encode(texts)
        out = self._encode(["" if i in whole else t for i, t in enumerate(texts)])
        for i, ids in zip(whole, self._ids(list(whole.values()))):
            out[i] = np.frombuffer(ids, self.kind)
        return out

    def _encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        if len(self.words) + len(self.parts) > self.cached // 2:
            self.older, self.words, self.parts = self.words, {}, {}
        heads: list[list[str]] = []
        rests: list[str] = []
        places: list[int] = []  # where each text's rest ends
        for text in texts:
            if _even(text):
                cut = text.replace("\n", " \n").split(" ")
                heads.append(cut[:1])
                rests += cut[1:]
            else:
                heads.append([text] if any(c in text for c in _DOUBTFUL) else _CHUNK.findall(text))
            places.append(len(rests))
        missing = list(set(chain.from_iterable(heads)).difference(self.parts))
        self.parts.update(zip(missing, self._ids(missing)))
        ids, ends = self._rests(rests)
        part, start, out = self.parts.__getitem__, 0, []
        for head, end in zip(heads, np.append(0, ends)[places].tolist()):
            before = np.frombuffer(b"".join(map(part, head)), self.kind)
            out.append(np.concatenate([before, ids[start:end]]))
            start = end
        return out

    def _rests(self, rests: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with the space before them, and where each one's end.

        Arrow tells the words apart, so that each is looked up once, and numpy deals out their ids.
        """
        coded = pa.array(rests, pa.string()).dictionary_encode()
        which = coded.indices.to_numpy()
        # No word has a space, and one split makes strings faster than a call for each.
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py()
        distinct = joined.split(" ") if len(which) else []
        words, older = self.words, self.older
        found = list(map(words.get, distinct))
        new = [w for w, ids in zip(distinct, found) if ids is None]
        words.update([(w, older[w]) for w in new if w in older])
        self._learn_words([w for w in new if w not in words])
        learnt = map(words.__getitem__, new)
        found = [next(learnt) if ids is None else ids for ids in found]
        flat = np.frombuffer(b"".join(found), self.kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // flat.itemsize
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        ids = flat[np.repeat(starts[which] - (ends - lengths), lengths) + np.arange(lengths.sum())]
        return ids, ends


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file.

    Functions that are sent by value bring new globals with every task, so what a worker keeps
    between tasks hangs on a module of the process.
    """
    kept = sys.modules.setdefault("tableloom_worker", ModuleType("tableloom_worker"))
    encoders = kept.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def text_groups(texts: Sequence[str], chars: int = 1 << 22) -> Iterable[slice]:
    """Slices of ``texts`` of about ``chars`` characters; a longer text is a slice alone."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > chars:
            yield slice(start, i)
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
