"""Token ids of whole texts, a word at a time with bounded caches in each Python worker."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from foliant.llm.common import SPACE, string_parts

END_ID = 1
#: Words whose ids a worker keeps; others are encoded again when met again.
CACHE_WORDS = 150_000
#: A word that is Latin letters, then perhaps marks: normalisation only lower-cases it, and its pre-tokens are these two parts. U+0130 is left out as it lower-cases to a letter and a mark.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,;:!?]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordEncoder:
    """Encodes the words between ASCII white space one at a time, for files whose normaliser and pre-tokenizer never join characters across white space; the ids of a text are then those of its words in a row.

    Each distinct word of a batch is encoded once. Latin words go to the file's model as the pre-tokens that the file's own rules make of them; any other word goes through the whole tokenizer. A probe compares both ways on construction; where they differ, every text is encoded whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cache_words = cache_words
        self.letters = _byte_letters()
        self.units: dict[str, bytes] = {}
        self.words: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        probe = "Ab, cD.\n  éÈ's 12\tÄöß, ŒUVRE; x\n<y don't … 日本 it's ñandú!? ... The"
        try:
            self.by_word = self._ids(probe) == np.frombuffer(b"".join(map(self._word, probe.split())), np.int32).tolist()
        except Exception:  # the model can't be asked for single pre-tokens
            self.by_word = False
        self.units.clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _unit(self, unit: str) -> bytes:
        found = self.units.get(unit)
        if found is None:
            spelt = unit if unit.isascii() else "".join(map(self.letters.__getitem__, unit.encode()))
            found = array("i", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            if len(self.units) < self.cache_words:
                self.units[unit] = found
        return found

    def _word(self, word: str) -> bytes:
        """A word's ids, 4 bytes each."""
        m = _PLAIN.fullmatch(word)
        if m is None:
            return array("i", self._ids(word)).tobytes()
        letters, marks = m.groups()
        return self._unit(letters.lower()) + self._unit(marks) if marks else self._unit(letters.lower())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (one more entry than texts)."""
        data, starts = string_parts(texts)
        if not self.by_word:
            each = [self._ids(bytes(data[a:b]).decode()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            return np.array([i for x in each for i in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
        # pieces end behind white space or at the end of a text: adjoining, so that one Arrow array holds them without a copy
        cut = np.zeros(len(data) + 1, bool)
        space = SPACE[data]
        cut[1:] = space
        cut[1:-1] &= ~space[1:]
        cut[starts] = True
        edges = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        known, base, new, rows = self.words, len(self.sizes), {}, []
        for piece in coded.dictionary.to_pylist():
            word = piece.strip(" \t\n\v\f\r")
            at = known.get(word)
            if at is None:
                at = new.setdefault(word, base + len(new))
            rows.append(at)
        learnt = [self._word(w) if w else b"" for w in new]
        new_sizes = np.fromiter(map(len, learnt), np.int64, len(learnt)) // 4
        new_flat = np.frombuffer(b"".join(learnt), np.int32)
        sizes, flat = np.concatenate([self.sizes, new_sizes]), np.concatenate([self.flat, new_flat])
        keep = max(0, min(len(new), self.cache_words - base))
        if keep:
            self.words.update(item for item, _ in zip(new.items(), range(keep), strict=False))
            self.sizes = sizes[: base + keep]
            self.flat = flat[: int(self.sizes.sum())]
        first = np.cumsum(sizes) - sizes
        index = np.array(rows, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        n = sizes[index]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[index] - (ends - n), n) + np.arange(int(ends[-1]))]
        before = np.concatenate([[0], ends])
        return ids, before[np.searchsorted(edges, starts)]


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """One per worker process and file."""
    if (path, cache_words) not in _ENCODERS:
        _ENCODERS[path, cache_words] = WordEncoder(path, cache_words)
    return _ENCODERS[path, cache_words]


def documents_ids(encode: WordEncoder, texts: pa.Array, end_id: int = END_ID):
    """Each text's ids with end_id behind them, in order, as uint32."""
    ids, starts = encode.encode(texts)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        out = np.empty(b - a + 1, np.uint32)
        out[:-1] = ids[a:b]
        out[-1] = end_id
        yield out
