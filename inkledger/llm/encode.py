"""Token ids of whole texts, by the tokenizers library, at the speed of a dictionary.

Pre-tokenization of both vocabularies never lets a token reach from a
non-space character into a space that follows it. A text cut at such places
therefore has the ids of its pieces, joined. Arrow cuts a slice of the texts
and numbers its different pieces (words, mostly); each is encoded once by a
worker, and the slice's ids are gathered by number. No cut parts a run of
white space. Marks after a word of Latin letters are tokens apart, so a new
word is encoded without them. A text that holds a literal of the vocabulary's
added tokens (``<|endoftext|>``) gets the library's ids of the whole text, where
that literal is one id. ``tests/llm/test_encode.py`` holds this against whole
texts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from inkledger.llm.shared import give_back

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
#: Pieces that a worker remembers before it forgets half; bounds its memory.
MEMORY = 600_000
#: Pieces longer than this are not remembered.
LONGEST = 32
#: The same for pieces that are no single word: long ones are rare.
SHORT = 16
#: Bytes of text encoded at a time.
SLICE = 3 << 20
#: The same two where nothing else takes a worker's or its executor's memory.
ROOMY = {"memory": 800_000, "slice_bytes": 8 << 20}
#: And where other stages have left their traces in both; such an encoder is let go after each task.
LEAN = {"memory": 150_000, "slice_bytes": 1 << 20}

#: Two characters of white space in a row, as str.isspace() has it (or the tokenizers; theirs is the smaller set).
_RUN = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]{2}"
_BEYOND_LATIN1 = "[^\\x{0}-\\x{ff}]"
#: Byte-level vocabularies write a byte as the character of its number, if that can be seen, and else by numbers from 256 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN) if b != 0x20}

#: Marks that are tokens apart after a letter.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_encoders: dict[tuple, "Encoder"] = {}


def vocabulary_path(name: str) -> str:
    return name if "/" in name else public_tokenizers.path(name)


class Encoder:
    def __init__(self, vocabulary: str, memory: int = MEMORY, slice_bytes: int = SLICE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.opening = os.path.commonprefix(self.literals)  # of marks, the same in either case
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        kind = self.tokenizer.pre_tokenizer.__class__.__name__
        # Sequence: white space is dropped, any space is a cut. ByteLevel: a space leads the next token.
        self.drops_space = self.lower = kind == "Sequence"
        self.lead = "" if self.drops_space else " "
        # Words of Latin letters need no more than the model. Many make one input, for each
        # has one token that ends it, or starts it, and so its ids are found again.
        vocabulary = self.tokenizer.get_vocab()
        self.model = Tokenizer(self.tokenizer.model)
        if self.drops_space:
            self.mark, self.latin = " ", re.compile("[a-zß-öø-ÿ]+").fullmatch
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            edge = [t.endswith(self.tokenizer.model.end_of_word_suffix) for t in vocabulary]
        else:  # "Ġ" is how byte-level vocabularies write the space before a word
            self.mark, self.latin = "Ġ", re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
            self.model.pre_tokenizer = pre_tokenizers.Split(self.mark, "merged_with_next")
            edge = [t.startswith(self.mark) for t in vocabulary]
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.edge[list(vocabulary.values())] = edge
        self.known: dict[str, bytes] = {}
        self.memory, self.slice_bytes = memory, slice_bytes

    def _encode(self, texts: list[str], by=None) -> list[bytes]:
        code = "H" if self.type.itemsize == 2 else "I"  # little-endian machines, as Spark's and Arrow's
        return [array(code, x.ids).tobytes() for x in (by or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of words of Latin letters (in lower case, if the vocabulary is)."""
        if not words:
            return []
        inputs = [self.mark + self.mark.join(_letters(" ".join(words[i : i + 500])).split(" ")) for i in range(0, len(words), 500)]
        ids = np.concatenate([np.array(x.ids, dtype=self.type) for x in self.model.encode_batch_fast(inputs, add_special_tokens=False)])
        at = np.flatnonzero(self.edge[ids]) * self.type.itemsize
        size = self.type.itemsize
        cuts = [0, *(at + size).tolist()] if self.drops_space else [*at.tolist(), len(ids) * size]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of pieces that are not known yet."""
        known, latin = self.known, self.latin
        plain: set[str] = set()
        first: set[str] = set()
        other, marked = [], []
        for p in new:
            word = p.rstrip(_MARKS)
            if word.isalpha() and (word.isascii() and (word.islower() or not self.lower) or latin(word)):
                if len(word) < len(p):
                    marked.append((p, word, p[len(word) :]))
                    if word in known:
                        continue
                plain.add(word)
            elif word[:1] == "\n" and latin(word, 1):
                if len(word) < len(p):
                    marked.append((p, word, p[len(word) :]))
                    if word in known:
                        continue
                first.add(word)
            else:
                other.append(p)
        learnt = dict(zip(plain, self._encode_words(list(plain)), strict=True))
        if first:
            line = self._encode(["\n"])[0]
            learnt.update(zip(first, [line + x for x in self._encode([_letters(p[1:]) for p in first], self.model)], strict=True))
        learnt.update(zip(other, self._encode([self._source(p) for p in other]), strict=True))
        marks = {m for _, _, m in marked}
        ends = dict(zip(marks, self._encode(list(marks)), strict=True))
        for p, word, mark in marked:
            learnt[p] = (known[word] if word in known else learnt[word]) + ends[mark]
        return learnt

    @staticmethod
    def _guarded(words: list[str]) -> list[str]:
        """Undoes cuts after white space, where a run of it would be parted."""
        out = [words[0]]
        for before, w in zip(words, words[1:], strict=False):
            if not before or before[-1].isspace():
                out[-1] += " " + w
            else:
                out.append(w)
        return out[:1] + [" " + w if not w or w[0].isspace() else w for w in out[1:]]

    def _source(self, piece: str) -> str:
        """What a piece stands for in a text."""
        return piece if piece[:1].isspace() else self.lead + piece

    def slices(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of the texts (strings, no null), end to end, and where each text's end: by slices of them."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + self.slice_bytes, "right")))
            yield self._slice(texts.slice(start, stop - start).cast(pa.large_string()))
            start = stop
        give_back()

    def batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in ``type``."""
        for ids, ends in self.slices(pa.array(list(texts), pa.large_string())):
            for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
                yield ids[a:b].tobytes()

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        return np.concatenate([np.empty(0, np.int64), *(np.diff(ends, prepend=0) for _, ends in self.slices(texts))])

    def _lookup(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > self.memory:
            # Every other piece goes; what is frequent is soon back.
            self.known = dict(list(self.known.items())[::2])
        ids = list(map(self.known.get, pieces))
        missing = [i for i, x in enumerate(ids) if x is None]
        fresh = self._learn(list({pieces[i] for i in missing}))
        for i in missing:
            ids[i] = fresh[pieces[i]]
        self.known.update((p, x) for p, x in fresh.items() if len(p) <= (LONGEST if p.isalpha() else SHORT))
        return ids

    def _without(self, texts: pa.Array, marked: pa.Array, into: dict[int, str]) -> pa.Array:
        """``texts`` with those that are ``marked`` moved to ``into``."""
        found = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        if not len(found):
            return texts
        into.update(zip(found.tolist(), texts.take(pa.array(found)).to_pylist(), strict=True))
        return pc.if_else(marked, pa.scalar("", texts.type), texts)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        apart: dict[int, str] = {}
        whole: dict[int, str] = {}
        if pc.any(pc.match_substring(texts, self.opening)).as_py():
            for literal in self.literals:  # in any case, for texts are lower-cased below
                texts = self._without(texts, pc.match_substring(texts, literal, ignore_case=True), whole)
        if self.drops_space:
            if self.lower:  # as the vocabulary's normalizer does; fewer pieces differ
                beyond = pc.match_substring_regex(texts, _BEYOND_LATIN1)
                texts = pc.if_else(beyond, texts, pc.utf8_lower(texts))
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            texts = self._without(texts, pc.match_substring_regex(texts, _RUN), apart)
            # No run of white space is left, so a line's end starts a piece as well.
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        firsts = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        pieces = cut.flatten().dictionary_encode()
        which = pieces.indices.to_numpy().copy()
        # No piece has a space in it, so one string of all comes apart again; that is faster than one by one.
        distinct = pa.LargeListArray.from_arrays([0, len(pieces.dictionary)], pieces.dictionary)
        ids = self._lookup(pc.binary_join(distinct, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")) if len(pieces.dictionary) else []
        if not self.drops_space:  # a text's first piece has no space before it
            heads = pieces.take(pa.array(firsts)).to_pylist()
            which[firsts] = len(ids) + np.arange(len(heads))
            ids += self._encode(heads)
        size = self.type.itemsize
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // size
        data = np.frombuffer(b"".join(ids), dtype=self.type)
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[which]
        # Numbers of 32 bits do for a slice; for one text of gigabytes they do not.
        kind = np.int32 if len(texts) > 1 or cut.values.nbytes < 1 << 30 else np.int64
        before = (np.cumsum(lengths) - lengths).astype(kind)
        places = np.repeat(starts[which].astype(kind) - before, lengths)
        places += np.arange(len(places), dtype=kind)
        out = data[places]
        ends = np.append(before, len(out))[np.append(firsts[1:], len(which))].astype(np.int64)
        if apart or whole:
            parts = np.split(out, ends[:-1])
            for k, text in whole.items():
                parts[k] = np.frombuffer(self._encode([text])[0], dtype=self.type)
            for k, text in apart.items():
                head, *rest = self._guarded(text.split(" "))
                parts[k] = np.frombuffer(self._encode([head])[0] + b"".join(self._lookup(rest)), dtype=self.type)
            out, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return out, ends


def _letters(text: str) -> str:
    """The characters that byte-level vocabularies have for the text's bytes, spaces apart."""
    return text.encode().decode("latin-1").translate(_LETTERS)


def encoder(vocabulary: str, memory: int = MEMORY, slice_bytes: int = SLICE) -> Encoder:
    """This worker's encoder; loaded once."""
    key = (vocabulary, memory, slice_bytes)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary, memory, slice_bytes)
    return _encoders[key]


def release(room: dict) -> None:
    """Lets a lean encoder go, so that a worker's other stages have its memory."""
    if room == LEAN:
        _encoders.clear()
        give_back()
