"""Token ids of whole texts, as the tokenizers library gives them, with the ids of frequent chunks kept.

Both vocabularies cut a text into pre-tokens that never cross a chunk: a run of characters that are not white space,
for the byte-level one with the single space before it. So the ids of a text are those of its chunks,
one after another, and the library needs to see each chunk only once in a while. Chunks of characters up to U+00FF and of
general punctuation, whose classes, case and composition no Unicode version has changed, are cut into pre-tokens here;
a chunk with any other character is encoded by the library as it stands. A text with white space beyond U+00FF or with an added token in
it goes through the library as a whole. Long texts are worked on in segments that end where a chunk does.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable

import numpy as np
import regex

#: White space up to U+00FF in the library's patterns.
_WHITE = r"\t-\r \x85\xa0"
#: White space beyond U+00FF, with what some versions of Unicode count as such.
FAR_WHITE = re.compile("[\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Characters that are cut by the library alone.
FOREIGN = re.compile("[^\x00-\xff\u2010-\u2027\u2030-\u205e]")
#: Of the word-level and the byte-level vocabulary: fixed values, the patterns by which their pre-tokens are cut.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks kept by a Python worker; no more are taken then, so that memory stays bounded (some 220 MB).
KEPT = 1_200_000
#: A longer chunk is not kept.
LONGEST = 40
#: Characters of a text that are worked on at a time.
SEGMENT = 1 << 20


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; a name with a folder in it is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode_all(texts): the ids of each as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str, most: int = KEPT) -> None:
        self.most = most
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary(name))
        self.library.no_truncation()
        self.library.no_padding()
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        normal = self.library.normalizer
        self.lower = normal is not None and "Lowercase" in repr(normal)
        pattern = repr(self.library.pre_tokenizer)
        words = self.lower and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in pattern.replace("\\\\", "\\")
        bytewise = normal is None and "ByteLevel(add_prefix_space=False" in pattern and "use_regex=True" in pattern and "Sequence" not in pattern
        self.chunk = re.compile(rf"[^{_WHITE}]+" if words else rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
        self.added = added if words or bytewise else None  # a text with one of these goes whole; None: all texts do
        self.edge = re.compile(rf"(?<=[^{_WHITE}])(?=[{_WHITE}])")
        # In a run of chunks, each has one token that ends (or, with a space before it, starts) a word: there the run's ids are cut.
        mark, self.at_end = ("</w>", True) if words else ("\u0120", False)
        self.marked = np.zeros(self.library.get_vocab_size(True), bool)
        for piece, k in self.library.get_vocab(False).items():
            self.marked[k] = piece.endswith(mark) if self.at_end else piece.startswith(mark)
        self.kept: dict[str, object] = {}
        self.missed = 0
        self.pretokens = regex.compile(WORD_PATTERN if words else BYTE_PATTERN).findall

    def whole(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def alone(self, chunk: str) -> bool:
        """Whether a run of such chunks can be cut at the marked tokens."""
        return chunk.isalpha() if self.at_end else chunk[0] == " " and len(chunk) > 1 and not chunk[1].isspace()

    def cuts(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a run of chunks that stand alone, and where each one's begin; None if the marks don't tell."""
        ids = np.asarray(self.whole((" " if self.at_end else "").join(chunks)), "<u4")
        at = np.flatnonzero(self.marked[ids])
        if len(at) != len(chunks):
            return None
        return ids, np.concatenate([[0], at + 1]) if self.at_end else np.append(at, len(ids))

    def value(self, ids: list[int]) -> object:
        return np.asarray(ids, "<u4").tobytes()

    def of_pretokens(self, pretokens: list[str]) -> dict[str, object]:
        """The value of each pre-token, through the library."""
        run = [x for x in pretokens if self.alone(x)]
        found = self.cuts(run) if run else None
        if found is None:
            run, out = [], {}
        else:
            data, ends = found[0].tobytes(), (found[1] * 4).tolist()
            out = {x: data[i:j] for x, i, j in zip(run, ends[:-1], ends[1:], strict=True)}
        if len(run) < len(pretokens):
            rest = [x for x in pretokens if x not in out]
            out.update((x, self.value(e.ids)) for x, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        return out

    #: The value of a chunk from those of its pre-tokens.
    joined = staticmethod(b"".join)

    def values(self, chunks: list[str]) -> dict[str, object]:
        """The values of new chunks, and of new pre-tokens in them."""
        cut = {x: self.pretokens(x) for x in chunks if not x.isalpha() and not FOREIGN.search(x)}
        kept = self.kept
        needed = {p for c in cut.values() for p in c if p not in kept}
        needed.update(x for x in chunks if x not in cut)
        out = self.of_pretokens(list(needed))
        for x, c in cut.items():
            if x not in out:
                out[x] = self.joined([out[p] if p in out else kept[p] for p in c])
        return out

    def chunks(self, text: str) -> list[str] | None:
        """None if the text must go through the library as a whole."""
        if self.added is None or any(x in text for x in self.added):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if FAR_WHITE.search(text):
                return None
            found = self.chunk.findall(text)  # the library folds the case of foreign chunks itself
            return [x if x.isascii() is False and FOREIGN.search(x) else x.lower() for x in found] if self.lower else found
        return self.chunk.findall(text.lower() if self.lower else text)

    def segments(self, text: str) -> list[str]:
        """The text in parts that end where a chunk does, of about SEGMENT characters."""
        cuts = [0]
        while len(text) - cuts[-1] > SEGMENT and (edge := self.edge.search(text, cuts[-1] + SEGMENT)):
            cuts.append(edge.start())
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]

    def learn(self, new: set[str]) -> dict[str, object]:
        """The values of chunks that are not kept; as many as there is room for are kept from now on."""
        found = self.values(list(new))
        room = self.most - len(self.kept)
        if room > 0:
            self.kept.update(itertools.islice(((k, v) for k, v in found.items() if len(k) <= LONGEST), room))
        else:
            self.missed += len(found)
            if self.missed > 8 * self.most:  # other words are frequent by now
                self.kept, self.missed = {}, 0
        return found

    def each(self, texts: list[str | None], of: Callable[[list[object]], object], whole: Callable[[list[int]], object]) -> list[object]:
        """of(values of its chunks) for each text, or whole(ids). of must take the values of parts, too."""
        long = {i: x for i, x in enumerate(texts) if x and len(x) > SEGMENT and self.chunks(x[:1]) is not None and not any(t in x for t in self.added) and not FAR_WHITE.search(x)}
        if long:
            parts = {i: of([self.each([y], of, whole)[0] for y in self.segments(x)]) for i, x in long.items() if self.edge.search(x, SEGMENT)}
            rest = iter(self.each([None if i in parts else x for i, x in enumerate(texts)], of, whole)) if parts else None
            if rest is not None:
                return [parts.get(i, v) for i, v in enumerate(rest)]
        cut = [self.chunks(x) if x else [] for x in texts]
        get = self.kept.get
        got = [None if c is None else list(map(get, c)) for c in cut]
        holes: list[tuple[list[object], list[str], int]] = []
        for c, v in zip(cut, got, strict=True):
            if v is not None and None in v:
                i = v.index(None)
                for _ in range(v.count(None) - 1):
                    holes.append((v, c, i))
                    i = v.index(None, i + 1)
                holes.append((v, c, i))
        if holes:
            found = self.learn({c[i] for _, c, i in holes})
            for v, c, i in holes:
                v[i] = found[c[i]]
        return [whole(self.whole(x)) if v is None else of(v) for x, v in zip(texts, got, strict=True)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        return self.each(texts, b"".join, self.value)


_loaded: dict[tuple[type, str, int], Encoder] = {}


def load(kind: type, name: str, most: int = KEPT, **more: object) -> Encoder:
    """One of a kind and file for each Python worker; more: what else its first maker needs."""
    if (kind, name, most) not in _loaded:
        _loaded.clear()  # a worker rarely needs two at a time
        _loaded[kind, name, most] = kind(name, most, **more)
    return _loaded[kind, name, most]


def encoder(name: str, most: int = KEPT) -> Encoder:
    return load(Encoder, name, most)


def forget() -> bool:
    """Whether there was anything to let go of."""
    had = bool(_loaded)
    _loaded.clear()
    return had
