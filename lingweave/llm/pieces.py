"""Splitting texts into pieces that a tokenizer treats independently, and bounded memories of what it made of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from sys import getsizeof
from typing import Any
from unicodedata import category

#: White space as tokenizers have it: Python's, without the four separator controls.
_SPACE, _DARK = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
_CHUNKS = re.compile(rf" ?{_DARK}+|{_SPACE}+(?!{_DARK})|{_SPACE}+")


class Unsafe(Exception):
    """A piece that white space beside it could change."""


class Memory(dict):
    """What ``make`` returned for each key, in at most about ``room`` bytes.

    When half of the room is full, what it holds becomes the older part, and the part before that is forgotten.  Keys in use thus stay.
    A memory belongs to the task that made it and goes with it: nothing is kept in a worker between tasks.
    """

    #: Fixed value: about what a key takes in a dictionary besides the objects themselves.
    ENTRY = 110

    def __init__(self, make: Callable[[Any], Any], room: int):
        super().__init__()
        self.make, self.room, self.used, self.older = make, room // 2, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        size = self.ENTRY + getsizeof(key) + getsizeof(value)
        if self.used + size > self.room:
            self.older = dict(self)
            self.clear()
            self.used = 0
        self.used += size
        self[key] = value
        return value


class SpaceLedPieces:
    """For byte-level tokenizers, whose pre-tokens may start with one space and hold no other white space beside text.

    ``encode`` gets a literal stretch of text and returns its value; ``specials`` are strings at which the tokenizer cuts texts
    first, each of them a stretch of its own.  A text with single spaces and at most two newlines on end is split at spaces and each piece is looked up.
    Any other text is cut by a pattern into runs of white space and dark runs (with their leading space), which are looked up in the same way.
    """

    def __init__(self, encode: Callable[[str], Any], room: int = 24 << 20, specials: Iterable[str] = ()):
        def led(piece: str):
            if piece != "\n" and (not piece or piece[-1].isspace() or piece[0].isspace() and (piece[0] != "\n" or piece[1].isspace())):
                raise Unsafe
            return encode(piece if piece[0] == "\n" else " " + piece)

        self.led, self.literal, self.specials = Memory(led, room), Memory(encode, room // 4), [*specials]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")

    def values(self, text: str) -> list[Any]:
        """The value of each piece of ``text``, in order."""
        for special in self.specials:
            if special in text:
                return [v for n, part in enumerate(self.cut.split(text)) for v in ([self.literal[part]] if n % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[Any]:
        spread = text.replace("\n", " \n")
        first, *rest = spread.split(" ")
        if not (first[-1:].isspace() or " \n \n " in spread or spread.endswith(" \n \n")):
            try:
                found = [*map(self.led.__getitem__, rest)]
                return [self.literal[first], *found] if first else found
            except Unsafe:
                pass
        return [*map(self.literal.__getitem__, _CHUNKS.findall(text))]


#: Up to here the character classes of the pattern modules agree (they follow other versions of Unicode); beyond, the library splits by itself.
LATEST_AGREED = "\u0500"
#: Up to here characters are their own NFC form and fold to lower case alike everywhere.
LATEST_PLAIN = "\u024f"
#: From the first character beyond to the last one of the words with such characters that stand side by side.
_FAR = re.compile("F(?:N*+(?: N*+)?F)*+".replace("F", f"[^\0-{LATEST_PLAIN}]").replace("N", f"[\0-\x1f!-{LATEST_PLAIN}]"))


class LibraryParts:
    """Encodes stretches of text with the model of a tokenizers file, part by part.

    The library's own normaliser and model do the work; the split into parts follows the file's pattern, and each part's ids are remembered (packed by
    ``pack``), so that ``word,`` and ``word.`` cost one call of the model.  A stretch with a special string in it goes through the library as a whole.
    """

    def __init__(self, path: str, pack: Callable[[list[int]], bytes], room: int = 24 << 20, tokenizer=None):
        import json

        import regex
        from tokenizers import Tokenizer

        from .bpe import PRETOKENS, byte_alphabet

        self.pack = pack
        self.tokenizer = tokenizer or Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        patterns = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"] or [PRETOKENS]
        if steps[-1]["type"] != "ByteLevel" or steps[-1]["add_prefix_space"] or len(patterns) != 1:
            raise ValueError("a byte-level tokenizer with one pattern and without prefix space is asked for")
        self.pattern = patterns[0]
        self.findall = regex.compile(self.pattern).findall
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        forms = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]] if spec["normalizer"] else [])]
        # White space within a stretch is left to the pattern, which must drop it if the normaliser changes it.
        self.folds, self.normalise = "Lowercase" in forms, self.tokenizer.normalizer.normalize_str if forms else None
        printed, tokenize = {b: c for c, b in byte_alphabet().items()}, self.tokenizer.model.tokenize

        def part(text: str) -> bytes:
            return pack([t.id for t in tokenize(text if text.isalnum() and text.isascii() else text.encode().decode("latin-1").translate(printed))])

        self.parts = Memory(part, room)

    def ids(self, stretch: str) -> bytes:
        last = max(stretch, default="")
        if last > LATEST_AGREED or any(s in stretch for s in self.specials):
            return self.pack(self.tokenizer.encode(stretch, add_special_tokens=False).ids)
        if self.normalise:
            stretch = stretch.lower() if self.folds and last <= LATEST_PLAIN else self.normalise(stretch)
        found = [*map(self.parts.__getitem__, self.findall(stretch))]
        return found[0] if len(found) == 1 else b"".join(found)


def spelt_out(pattern: str) -> str | None:
    """A pattern of the ``regex`` module for the standard module, which is twice as fast, with its classes spelt out; None if it has anything besides.

    The classes hold what may become of characters up to ``LATEST_AGREED`` when they are folded, so other texts are not for it.
    """
    known = sorted({c for n in range(ord(LATEST_AGREED) + 1) for c in chr(n) + chr(n).lower()})
    dark = re.compile(_DARK).fullmatch
    out, inside, rest = [], False, pattern
    while rest:
        step = re.match(r"\\p\{(\^?)([LMNPSZC][a-z]?)\}|(\\s)|\\[^A-Za-z0-9]|\\[rntfv]|\(\?[:=!]|\((?!\?)|[^\\(]", rest)
        if not step or inside and step[0] == "[":
            return None
        if step[2] or step[3]:
            held = [c for c in known if (not dark(c) if step[3] else category(c).startswith(step[2]) != bool(step[1]))]
            spelt = "".join(map(re.escape, held))
            out.append(spelt if inside else f"[{spelt}]")
        else:
            inside = step[0] == "[" or inside and step[0] != "]"
            out.append(step[0])
        rest = rest[step.end() :]
    return "".join(out)


class SpacelessPieces:
    """For tokenizers that drop all white space: words between spaces and newlines are independent.

    If the tokenizer lower-cases, whole texts of characters up to ``LATEST_PLAIN`` are folded and cut into parts at once, so that a word costs one call of the model
    whatever stands beside it; a word with any other character is looked up by itself, and so are all words of a text with a special string.
    """

    def __init__(self, library: LibraryParts, room: int = 48 << 20):
        own = spelt_out(library.pattern) if library.folds else None
        self.cut = re.compile(own).findall if own else None
        self.words, self.parts, self.specials = Memory(library.ids, room), library.parts, library.specials

    def values(self, text: str) -> list[Any]:
        spread = text.replace("\n", " ")
        if not self.cut or any(s in text for s in self.specials):
            return [*map(self.words.__getitem__, spread.split(" "))]
        found, at = [], 0
        while far := None if text.isascii() else _FAR.search(spread, at):
            start, end = spread.rfind(" ", at, far.start()) + 1 or at, spread.find(" ", far.end())
            found += self._plain(spread[at:start])
            at = end if end >= 0 else len(spread)
            found += map(self.words.__getitem__, spread[start:at].split(" "))
        found += self._plain(spread[at:])
        return found

    def _plain(self, stretch: str) -> Iterator[Any]:
        return map(self.parts.__getitem__, self.cut(stretch.lower()))
