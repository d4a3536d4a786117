"""Token ids of whole texts, unit by unit: a text is cut where white space follows a word, and a unit that was met before is not tokenised again.

The cuts are right where a vocabulary splits texts there itself, or where its pieces never hold white space after anything
else; both are looked up when it is loaded, and texts of any other vocabulary are one unit each.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the byte-level splitter, as a character class.
SPACE = " \t-\r\x85\xa0  -     　"
#: White space, then a word; a return never begins a unit, as some vocabularies have pieces that end in one.
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+(?:\r[{SPACE}]*[^{SPACE}]*)*|[{SPACE}]+")
#: Texts with white space before a space: only these need the pattern, others are cut before each space.
_ODD = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_ACROSS = re.compile(f"[^{SPACE}][\t-\f {SPACE[5:]}]")
#: Characters, units and parts of units that a worker remembers before it starts afresh; bounds on memory that change no result.
REMEMBERED_CHARS, REMEMBERED_UNITS, REMEMBERED_PARTS = 12_000_000, 800_000, 500_000


def cuts_before_space(pieces) -> bool:
    """Whether no piece, written with plain spaces, holds white space (other than a return) after anything else."""
    return not any(_ACROSS.search(p) for p in pieces)


def unit_slots(texts: pa.Array, lookup: Callable[[list[str]], np.ndarray], cut: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(slots, offsets): of each text in order, the slots that lookup gives to its units. A null is an empty text; an empty text has the unit ''."""
    texts = texts.cast(pa.large_string())
    texts = texts.fill_null("") if texts.null_count else texts
    if not cut:
        return lookup(texts.to_pylist()), np.arange(len(texts) + 1)
    odd = pc.match_substring_regex(texts, _ODD)
    parts = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    at = parts.offsets.to_numpy().astype(np.int64)
    words = parts.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    at = at - at[0]
    slots = lookup([" " + w for w in _strings(words.dictionary)])[words.indices.to_numpy()]
    slots[at[:-1]] = lookup(words.take(pa.array(at[:-1])).to_pylist())
    strange = odd.to_numpy(zero_copy_only=False)
    if not strange.any():
        return slots, at
    found = [UNIT.findall(t) for t in texts.filter(odd).to_pylist()]
    count = np.diff(at)
    plain = slots[np.repeat(~strange, count)]
    count[strange] = [len(u) for u in found]
    out = np.empty(count.sum(), slots.dtype)
    own = np.repeat(strange, count)
    out[own], out[~own] = lookup([u for units in found for u in units]), plain
    return out, np.concatenate([[0], np.cumsum(count)])


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Runs:
    """Runs of numbers end to end, which grow; gather() puts chosen runs side by side."""

    def __init__(self, dtype):
        self.flat, self.n = np.zeros(1024, dtype), 0
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, length: np.ndarray) -> None:
        if self.n + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.n], np.zeros(self.n + len(flat), self.flat.dtype)])
        self.flat[self.n : self.n + len(flat)] = flat
        self.start = np.concatenate([self.start, self.n + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.n += len(flat)

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen runs end to end, and their lengths."""
        length = self.length[slots]
        first = np.cumsum(length) - length
        at = np.repeat(self.start[slots] - first, length) + np.arange(length.sum())
        return self.flat[at], length


class Remembered:
    """Slots of units. New units are handed to learn() all at once."""

    most_units, most_chars = REMEMBERED_UNITS, REMEMBERED_CHARS

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0

    def learn(self, units: list[str]) -> None:
        raise NotImplementedError

    def lookup(self, units: list[str]) -> np.ndarray:
        known = self.known
        out = list(map(known.get, units))
        if None in out:
            new = list(dict.fromkeys(u for u, k in zip(units, out, strict=True) if k is None))
            self.learn(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.chars += sum(map(len, new))
            out = map(known.__getitem__, units)
        return np.fromiter(out, np.int64, len(units))

    def trim(self) -> None:
        """To be called between slices: forgets all once the bounds are passed."""
        if self.chars > self.most_chars or len(self.known) > self.most_units:
            self.forget()


class ByteIds:
    """Ids of the byte-level vocabulary of a tokenizers file, without special tokens.

    plain says whether the strings of special tokens are ordinary text.
    """

    #: Units of these characters alone are split here as the vocabulary's own splitter does it, and their parts remembered.
    _LETTER, _MARK = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"!-/:-@\[-`{-~"
    _split = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+|[ \n]+(?![^ \n])|[ \n]+")

    def __init__(self, path: str, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.size = self.tokenizer.get_vocab_size()
        self.parts: dict[str, list[int]] = {}
        shape = json.loads(self.tokenizer.to_str())
        split = shape["pre_tokenizer"] or {}
        self.cut = not shape["normalizer"] and (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) == ("ByteLevel", True, False)

    def _part(self, part: str) -> tuple[int, ...]:
        if len(self.parts) > REMEMBERED_PARTS:
            self.parts.clear()
        shown = part.replace(" ", "Ġ") if part.isascii() and "\n" not in part else part.encode().decode("latin-1").translate(_SHOWN)
        out = self.parts[part] = tuple([t.id for t in self.tokenizer.model.tokenize(shown)])  # tuples of numbers are no burden to the collector
        return out

    def encode(self, units: list[str]) -> list[list[int]]:
        split, whole, known, own, out = self._split.findall, self.tokenizer.encode, self.parts, self._part, []
        for u in units:
            parts = split(u)
            if "".join(parts) != u or "<|" in u:  # other characters, or a special token
                out.append(whole(u, add_special_tokens=False).ids)
            else:
                ids = []
                for part in parts:
                    ids += known.get(part) or own(part)
                out.append(ids)
        return out


#: How the byte-level vocabularies write each byte: printable ones as they are, the others from code point 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


def byte_pieces(tokenizer) -> dict[int, str]:
    """Id to piece, where each character stands for one byte (of the number of its code point)."""
    back = {c: chr(b) for b, c in _SHOWN.items()}
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    return {i: special[i].encode().decode("latin-1") if i in special else "".join(back[c] for c in w) for w, i in tokenizer.get_vocab().items()}


class PieceIds:
    """Ids of a sentencepiece model for units of a text that was given a space before it."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False  # units bring their spaces with them
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.size = self.model.vocab_size()
        self.pieces = {i: self.piece(i) for i in range(self.size)}
        self.cut = cuts_before_space(p.decode("utf-8", "replace") for p in self.pieces.values())

    def piece(self, i: int) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(self.model.id_to_piece(i)[3:-1], 16)])
        return self.model.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.model.encode(units, num_threads=1)


_held: dict[tuple, ByteIds | PieceIds] = {}


def vocabulary(kind, path: str, *args):
    """The loaded vocabulary of a worker; loaded once."""
    key = (kind.__name__, path, *args)
    if key not in _held:
        _held[key] = kind(path, *args)
    return _held[key]


def public_path(name: str) -> str:
    """Where the installed public vocabulary file of that name is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class UnitIds(Remembered):
    """Ids of a text's units by one byte-level vocabulary."""

    def __init__(self, vocabulary: ByteIds):
        self.vocabulary = vocabulary
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.ids = Runs(np.uint32)

    def learn(self, units: list[str]) -> None:
        ids = self.vocabulary.encode(units)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids.add(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, length.sum()), length)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the n + 1 offsets."""
        self.trim()
        slots, at = unit_slots(texts, self.lookup, self.vocabulary.cut)
        flat, length = self.ids.gather(slots)
        return flat, np.concatenate([[0], np.cumsum(length)])[at]
