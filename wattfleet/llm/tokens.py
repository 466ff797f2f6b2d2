"""Token ids of texts, with a vocabulary file of the tokenizers library.

Where a tokenizer drops white space and merges inside words only, the ids of a text
are those of its words one after the other. Texts are worked on some millions of
characters at a time: their distinct words are cut into pieces, the library's model
gets the distinct pieces in a few calls, and the ids are gathered by place. Words and
pieces repeat, so each Python worker keeps the ids of those it has met, up to a fixed
number, as arrays. Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

#: Words, and pieces of words, a worker remembers; beyond that only those it has just met again. Bounds memory only.
REMEMBERED = 200_000
#: Characters of the texts worked on at a time.
STRETCH = 1 << 21
#: Pieces in a call of the library, which makes a record of each token.
_PIECES = 1 << 14
#: All characters below this are composed already and have had their classes since Unicode 1.1.
_STABLE = "Ƞ"


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _ranges(kind: str) -> str:
    """The characters below `_STABLE` of a general category, as the inside of a character class."""
    codes = [c for c in range(ord(_STABLE)) if unicodedata.category(chr(c))[0] == kind]
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


def _plain_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of characters below `_STABLE`, without properties, which the standard library lacks."""
    if re.search(r"\\[a-zA-Z]", re.sub(r"\[[^\]]*\]", "", pattern)):
        return None  # a class outside brackets
    for name, inside in ((r"\p{L}", _ranges("L")), (r"\p{N}", _ranges("N")), (r"\s", r"\t-\r \x85\xa0")):
        pattern = pattern.replace(name, inside)
    return None if r"\p" in pattern else re.compile(pattern)


def _odd_pattern() -> re.Pattern:
    """Finds words that may hold special tokens, or characters from `_STABLE` on, in lower case too."""
    grown = "".join(chr(c) for c in range(ord(_STABLE)) if max(chr(c).lower()) >= _STABLE)
    return re.compile(f"[{_STABLE}-\U0010ffff{grown}]|<\\|")


def _listed(lines: pa.Array) -> list[str]:
    """The strings of an array, none of which holds a line end; several times faster than one by one."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines)
    return pc.binary_join(whole, "\n")[0].as_py().split("\n")


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` with these starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    small = np.int32 if len(flat) < 1 << 31 and ends[-1:].sum() < 1 << 31 else np.int64
    places = np.repeat((starts - (ends - sizes)).astype(small), sizes)
    places += np.arange(len(places), dtype=small)
    return flat[places]


class _Known:
    """Ids of strings that a worker has met; ``make`` gives the ids of other ones, one after the other, and their numbers.

    The line end is known from the start, and has no ids.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.make = make
        self._keep(["\n"], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def __len__(self) -> int:
        return len(self.places)

    def _keep(self, strings: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        # A string asked for the first time gets the next place.
        self.places = defaultdict(count(len(strings)).__next__, zip(strings, range(len(strings)), strict=True))
        self.ids, self.sizes, self.starts = ids, sizes, np.cumsum(sizes) - sizes

    def find(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The place of each string, and by place: all ids, where those of a string start, and how many they are."""
        places, before = self.places, len(self.places)
        place = np.fromiter(map(places.__getitem__, strings), np.int64, len(strings))
        if len(places) > before:
            fresh = list(islice(reversed(places), len(places) - before))[::-1]
            try:
                ids, sizes = self.make(fresh)
            except BaseException:
                for string in fresh:
                    del places[string]
                places.default_factory = count(before).__next__
                raise
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
            self.ids, self.sizes = np.append(self.ids, ids), np.append(self.sizes, sizes)
        found = place, self.ids, self.starts, self.sizes
        if len(places) > REMEMBERED:
            kept = list(dict.fromkeys(["\n", *compress(strings, (place < before).tolist())]))[:REMEMBERED]
            at = np.array([places[k] for k in kept])
            self._keep(kept, gathered(self.ids, self.starts[at], self.sizes[at]), self.sizes[at])
        return found


class Encoder:
    """Ids of texts as bytes, each id a little-endian unsigned 32-bit integer."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.pattern = self._word_pattern(spec)
        self.plain = _plain_pattern(self.pattern.pattern) if self.pattern else None
        self.odd = _odd_pattern()
        self.words, self.pieces = _Known(self._words), _Known(self._pieces)
        model = self.tokenizer.model
        # The lengths of the tokens tell where a piece ends.
        if self.plain is not None and not (model.unk_token or model.continuing_subword_prefix or model.dropout):
            vocabulary, suffix = self.tokenizer.get_vocab(with_added_tokens=False), model.end_of_word_suffix or ""
            self.lengths = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
            self.lengths[list(vocabulary.values())] = [len(t.removesuffix(suffix)) for t in vocabulary]
            self.cut = re.compile(f"(?:{self.plain.pattern})|\n")
            self.bare = Tokenizer(model)
            self.bare.pre_tokenizer = WhitespaceSplit()
            self.letters = "".join(" " if b == ord(" ") else letter for b, letter in sorted(_byte_letters().items()))
        else:
            self.cut = None
        # A task has one core; the library would start a thread for each core of the machine.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    @staticmethod
    def _word_pattern(spec: dict) -> regex.Pattern | None:
        """The pattern of pieces, for a tokenizer whose words do not touch each other; else None."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        split = steps[0] if steps else {}
        if (
            [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and split.get("behavior") == "Removed" and split.get("invert") and "Regex" in split.get("pattern", {})
            and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
            and normal == ["NFC", "Replace", "Lowercase"] and spec.get("post_processor") is None
            and not any(a["lstrip"] or a["rstrip"] or " " in a["content"] for a in spec.get("added_tokens", []))
        ):
            return regex.compile(split["pattern"]["Regex"])
        return None

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each has."""
        ids, sizes = [], []
        for at in range(0, len(pieces), _PIECES):
            part = codecs.charmap_decode(" ".join(pieces[at : at + _PIECES]).encode(), "strict", self.letters)[0]
            listed = part.split(" ")
            found = np.array(self.bare.encode_batch_fast([part], add_special_tokens=False)[0].ids, np.uint32)
            reached, ends = np.cumsum(self.lengths[found]), np.cumsum(list(map(len, listed)))
            last = np.searchsorted(reached, ends)
            if np.array_equal(np.append(reached, 0)[last], ends):
                sizes.append(np.diff(last, prepend=-1))
            else:  # the vocabulary lacks letters, which the library drops
                sizes.append(np.array([len(e.ids) for e in self.bare.encode_batch_fast(listed, add_special_tokens=False)]))
            ids.append(found)
        return np.concatenate(ids), np.concatenate(sizes)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        joined, odd = "\n".join(words), {}
        if self.odd.search(joined):
            odd = {i: self._whole(w) for i, w in enumerate(words) if self.odd.search(w)}
            joined = "\n".join(["" if i in odd else w for i, w in enumerate(words)])
        piece, ids, start, size = self.pieces.find(self.cut.findall(joined.lower()))
        sizes = np.bincount(np.cumsum(piece == 0), size[piece], len(words)).astype(np.int64)
        ids = gathered(ids, start[piece], size[piece])
        if odd:
            starts, at = np.cumsum(sizes) - sizes, np.fromiter(odd, np.int64)
            own = [len(found) for found in odd.values()]
            ids = np.insert(ids, np.repeat(starts[at], own), np.concatenate(list(odd.values())))
            sizes[at] = own
        return ids, sizes

    def _stretch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by ``end_id``, and how many each has."""
        if self.cut is None:
            found = [np.append(self._whole(t), np.uint32(end_id)) for t in texts.to_pylist()]
            return np.concatenate(found), np.array([len(f) for f in found])
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        place, ids, starts, sizes = self.words.find(_listed(words.dictionary))
        # The end is a word of its own behind the last one of each text.
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        word = np.insert(place[words.indices.to_numpy()], ends, len(sizes))
        ids, starts, sizes = np.append(ids, np.uint32(end_id)), np.append(starts, len(ids)), np.append(sizes, 1)
        size = sizes[word]
        reached = np.cumsum(size)[ends + np.arange(len(ends))]
        return gathered(ids, starts[word], size), np.diff(reached, prepend=0)

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return next(self.encode_all(pa.array([text], pa.string()), 0))[:-4]

    def encode_all(self, texts: pa.Array, end_id: int) -> Iterator[bytes]:
        """For each text its ids and ``end_id``, as little-endian unsigned 32-bit integers."""
        texts = texts.cast(pa.string())
        reached = np.cumsum(pc.utf8_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            before = reached[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(reached, before + STRETCH, "right")))
            ids, counts = self._stretch(texts.slice(at, stop - at), end_id)
            coded, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
            for start, end in zip((ends - 4 * counts).tolist(), ends.tolist(), strict=True):
                yield coded[start:end]
            at = stop


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    return Encoder(path)
