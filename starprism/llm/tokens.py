"""Exact token ids of whole texts, with the ids of each distinct word computed once.

Both tokenizers split a text before they merge, and no split spans the places used here: white space for the word
tokenizer, which drops it; for the byte tokenizer a single space between two other characters, which goes to the part
after it, and both sides of a single line end between two other characters. So a text's ids are those of its parts, one after another, and parts repeat.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from starprism.llm.common import Rows, kept, list_parts, spread

_SPLIT = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

_SPACE, _LINE, _WORD_END = "\u0120", "\u010a", "</w>"  # fixed values: how the vocabularies write a space, a line end and a word's end


def encoder(path: str, spaces: bool, most_words: int = 600_000, most_ids: int = 4_000_000) -> Encoder:
    """The worker's encoder for a file; its cache serves all tasks that the worker runs, until one of another kind drops it."""
    return kept((path, spaces, most_words, most_ids), lambda: Encoder(path, spaces, most_words, most_ids))


def _ragged(parts: pa.Array) -> pa.Array:
    """Parts that are empty or have white space at an end, but for one line end before them: their texts have runs of
    white space."""
    body = pc.replace_substring_regex(parts, r"\A\n", "")
    return pc.or_(pc.equal(pc.binary_length(body), 0), pc.not_equal(pc.binary_length(pc.utf8_trim_whitespace(body)), pc.binary_length(body)))


class Encoder:
    """Ids by a file of the tokenizers library. ``spaces``: whether ids keep white space (byte tokenizer); if not, the tokenizer lower-cases.

    The ids of the words that come first are kept, up to a bound; other words' ids are computed in the batch that has
    them. If most words of a batch are new, the kept ones are of other texts and go.
    """

    def __init__(self, path: str, spaces: bool, most_words: int = 600_000, most_ids: int = 4_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaces, self.most_words, self.most_ids = spaces, most_words, most_ids
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        flags = lambda test: np.isin(np.arange(size), [i for token, i in vocabulary.items() if test(token)])
        self.space, self.line, self.end = flags(lambda t: t[0] == _SPACE), flags(lambda t: t[0] == _LINE), flags(lambda t: t.endswith(_WORD_END))
        self._reset()

    def _reset(self) -> None:
        self.kept = pa.array([], pa.string())  # words by number
        self.ids, self.first, self.count = Rows((), np.int32), Rows((), np.int64), Rows((), np.int64)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has; one text for each word."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths

    def _marked(self, words: list[str], mark: np.ndarray, begins: bool, each: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The same with many words in a text, where ids of which ``mark`` tells begin (or end) a word's ``each`` parts.
        Words whose marks don't come out even go one by one."""
        ids, lengths = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for a in range(0, len(words), 4000):
            some = words[a : a + 4000]
            found = np.array(self.tokenizer.encode_batch_fast([("" if begins else " ").join(some)], add_special_tokens=False)[0].ids, np.int32)
            marks = np.flatnonzero(mark[found])
            if len(marks) == each * len(some):
                marks = marks[::each] if begins else marks[each - 1 :: each]
                ids.append(found)
                lengths.append(np.diff(np.append(marks, len(found))) if begins else np.diff(marks, prepend=-1))
            else:
                one, n = self._each(some)
                ids.append(one)
                lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Words' ids under the next numbers."""
        self.first.add(self.ids.n + np.cumsum(lengths) - lengths)
        self.count.add(lengths)
        self.ids.add(ids)

    def _new(self, words: pa.Array) -> np.ndarray:
        """Adds new words, each by the cheapest way; returns their numbers."""
        if self.spaces:
            line = pc.starts_with(words, "\n")
            plain = pc.invert(_ragged(words))
            kinds = [(pc.and_(plain, pc.invert(line)), lambda w: self._marked([" " + x for x in w], self.space, True)), (pc.and_(plain, line), lambda w: self._marked(w, self.line, True)), (pc.invert(plain), lambda w: self._each([" " + x for x in w]))]
        else:
            letters = pc.utf8_is_alpha(words)
            stop = pc.match_substring_regex(words, r"^\pL+[.,;:!?]$")
            kinds = [(letters, lambda w: self._marked(w, self.end, False)), (stop, lambda w: self._marked(w, self.end, False, 2)), (pc.invert(pc.or_(letters, stop)), self._each)]
        out = np.empty(len(words), np.int64)
        for which, encode in kinds:
            at = np.flatnonzero(which.to_numpy(zero_copy_only=False))
            out[at] = self.first.n + np.arange(len(at))
            self._add(*encode(words.take(pa.array(at)).to_pylist()))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), and where each text's ids begin, with the end last."""
        parts, offsets = list_parts(pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ") if self.spaces else pc.ascii_split_whitespace(pc.ascii_lower(texts)))
        coded = parts.dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy()
        found = pc.index_in(words, value_set=self.kept).fill_null(-1).to_numpy().astype(np.int64)
        new = found < 0
        if new.sum() > 0.7 * len(new) and len(self.kept) > self.most_words // 2:
            self._reset()
            new[:] = True
        before = self.ids.n, self.first.n
        if new.any():
            fresh = words.filter(pa.array(new))
            found[new] = self._new(fresh)
            if self.first.n <= self.most_words and self.ids.n <= self.most_ids:
                self.kept = pa.concat_arrays([self.kept, fresh.take(pa.array(np.argsort(found[new])))])
                before = self.ids.n, self.first.n
        numbers = found[which]
        if self.spaces and len(texts):
            heads = offsets[:-1]
            first = words.take(coded.indices.take(pa.array(heads))).to_pylist()
            numbers[heads] = self.first.n + np.arange(len(first))
            self._add(*self._each(first))  # a text's first part has no space before it
            ragged = _ragged(words).to_numpy(zero_copy_only=False)[which]
            bad = np.flatnonzero((np.diff(offsets) > 1) & (np.add.reduceat(ragged, heads, dtype=np.int64) > 0))
            if len(bad):  # runs of white space: these texts' parts are cut with care
                pieces = [numbers[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                for i in bad:
                    head, *rest = _SPLIT.split(texts[int(i)].as_py())
                    own = list(dict.fromkeys([head, *(" " + w for w in rest)]))
                    place = {w: self.first.n + j for j, w in enumerate(own)}
                    self._add(*self._each(own))
                    pieces[i] = np.array([place[head], *(place[" " + w] for w in rest)])
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
                numbers = np.concatenate(pieces)
        lengths = self.count.data[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = self.ids.data[spread(self.first.data[numbers], lengths)]
        self.ids.n, self.first.n, self.count.n = before[0], before[1], before[1]  # what isn't kept goes
        return out, ends[offsets]
