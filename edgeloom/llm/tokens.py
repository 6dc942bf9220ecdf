"""Token ids by a ``tokenizers`` file, with a bounded cache of words.

A byte-level tokenizer's pre-tokens never cross a single space or newline between two other
characters, so a text that has white space only in that way is a sequence of units: a newline, or a
word with its leading space. Units repeat, so most are found in a cache; ids are kept as
little-endian 32-bit bytes and a text is one join. Any other text (runs of white space, other
blanks, blanks at an end) is encoded as a whole, and so is a text that has the string of a special or added
token, which the tokenizer's own rules decide on; both ways give the same ids.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable

_PLAIN = re.compile(r" ?\S+")
_POINTS = ".,!?;:|"
_KNOWN: dict[str, object] = {}


def load(path: str):
    """The tokenizer of a file; loaded once a process."""
    if path not in _KNOWN:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _KNOWN[path] = Tokenizer.from_file(path)
    return _KNOWN[path]


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves,
    the others for code points from 256 up, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


def encoder(path: str, most: int = 1_000_000) -> Callable[[str], bytes]:
    """A function of a text to its ids as bytes, four each; ``most`` bounds the cache's units."""
    t = load(path)
    pack = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    whole = lambda s: pack(t.encode(s, add_special_tokens=False).ids)
    by_units = t.normalizer is None and type(t.pre_tokenizer).__name__ == "ByteLevel" and not t.pre_tokenizer.add_prefix_space
    added = [x.content for x in t.get_added_tokens_decoder().values() if x.content]
    has_added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
    letters = _byte_letters()
    model, space = t.model, letters[32]
    cache: dict[str, bytes] = {}

    def word(u: str) -> bytes:
        """Ids of one pre-token of letters."""
        said = u.replace(" ", space) if u.isascii() else u.encode().decode("latin-1").translate(letters)
        return pack([x.id for x in model.tokenize(said)])

    def learn(u: str) -> bool:
        """Adds a unit; False if it isn't plain."""
        bare = u[1:] if u[:1] == " " else u
        core = bare.rstrip(_POINTS)
        if core.isalpha():
            if len(core) == len(bare):
                cache[u] = word(u)
            else:
                head = u[: len(u) - len(bare) + len(core)]
                if head not in cache:
                    cache[head] = word(head)
                tail = bare[len(core) :]
                if tail not in cache:
                    cache[tail] = whole(tail)
                cache[u] = cache[head] + cache[tail]
        elif u == "\n" or _PLAIN.fullmatch(u):
            cache[u] = whole(u)
        else:
            return False
        return True

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if not by_units or "\0" in text or has_added(text):
            return whole(text)
        units = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        if len(cache) > most:
            cache.clear()
        for u in set(units).difference(cache):
            if not learn(u):
                return whole(text)
        return b"".join(map(cache.__getitem__, units))

    return encode
