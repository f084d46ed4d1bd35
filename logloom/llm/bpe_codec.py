"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can end its encoding. An automaton over the vocabulary gives all tokens
that end at a position; the one kept is compatible with the last token of the prefix before it, which holds if no merge
across their border would have come first while either was built. Back-pointers from the whole word give the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import loaded, tidy
from .textnum import Memo, char_chunks, code_points, distinct, prefix_hash, span_hash, texts

END = ""  # stands for the end-of-word suffix, once
_NONE, _LETTER, _NUMBER, _OTHER = range(4)
#: The pattern that the vocabulary's own file states; others are refused.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The printable letter for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@loaded(1)
def classes() -> np.ndarray:
    """For each code point: none (white space), letter, number or other."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "x" for c in range(0x110000))
    out = np.full(0x110000, _OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\p{White_Space}+", _NONE)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


@loaded(1)
def unsettled() -> np.ndarray:
    """Code points on which editions of Unicode differ; the tokenizer library is asked for each that occurs."""
    kind = {"L": _LETTER, "N": _NUMBER}
    own = np.array([255 if (g := unicodedata.category(chr(c))) == "Cn" else kind.get(g[0], _OTHER) for c in range(0x110000)], np.uint8)
    known = classes()
    return (own != known) & (known != _NONE)


@loaded(1)
def moved() -> np.ndarray:
    """Code points that the tokenizer library's edition of Unicode orders or composes differently in NFC."""
    import regex
    from tokenizers.normalizers import NFC

    out, known = np.zeros(0x110000, bool), [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = [*filter(unicodedata.decomposition, known), *regex.findall(r"\p{M}", "".join(known))]
    # marks of the least and of a high class move around a mark that has a class
    for tried in (every, [unicodedata.normalize("NFD", c) for c in every], [c + "\u0334" for c in every], ["\u0315" + c for c in every]):
        lines = "\n".join(tried)
        for c, own, other in zip(every, unicodedata.normalize("NFC", lines).split("\n"), NFC().normalize_str(lines).split("\n"), strict=True):
            if own != other:
                out[ord(c)] = True
    return out


class WordCodec:
    """Words and ids of a word-end BPE vocabulary file (NFC, lower case, white space dropped, byte-level letters)."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if split["pattern"].get("Regex") != PATTERN or [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError("not a vocabulary of the kind that this codec reads")
        suffix, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        inner = lambda piece: piece[: -len(suffix)] + END if piece.endswith(suffix) else piece
        self.shown = {i: piece for piece, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.shown |= {i: s for s, i in self.special.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pair_rank, self.rank, self.halves = {}, {}, {}
        for k, (a, b) in enumerate(spec["model"]["merges"]):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.pair_rank[left, right] = k
            if made not in self.rank:
                self.rank[made], self.halves[made] = k, (left, right)
        self.auto = ahocorasick.Automaton()
        for piece, i in vocab.items():
            if piece not in self.special:
                body = inner(piece)
                self.auto.add_word(body, (i, len(body) - body.endswith(END)))
        self.auto.make_automaton()
        self.letters, self.fits = byte_letters(), {}
        self.path, self.kind, self.ask, self.low = path, classes().copy(), unsettled().copy(), {}
        self.moved = moved()
        self.rare = unsettled() | self.moved

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in the encoding of their joined text."""
        key = left, right
        if (known := self.fits.get(key)) is not None:
            return known
        limit, ok = len(self.pair_rank), True
        while True:
            if self.pair_rank.get((left, right), limit) < limit:
                ok = False
                break
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                break
            if a > b:  # the left was finished last: undo that
                limit, left = a, self.halves[left][1]
            else:  # ties go to the leftmost pair, so an equal rank across the border comes first
                limit, right = b + 1, self.halves[right][0]
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word as the pattern splits them (not empty)."""
        body = "".join(map(self.letters.__getitem__, word.encode()))
        n = len(body)
        last: list[tuple[int, int]] = [(-1, 0)] * (n + 1)
        for at, (token, size) in self.auto.iter(body + END):
            i = at + 1
            if i > n:
                i = n
            elif i == n:
                continue  # the last letter always bears the end of the word
            if last[i][0] < 0:
                j = i - size
                before = last[j][0]
                if not j or before >= 0 and self.compatible(before, token):
                    last[i] = token, j
        ids, i = [], n
        while i:
            token, i = last[i]
            if token < 0:
                raise ValueError(f"no encoding of {word!r}")
            ids.append(token)
        return ids[::-1]

    def settle(self, rows: list[str]) -> list[str]:
        """Learns the class and the small form of code points that editions of Unicode treat differently."""
        from tokenizers import Tokenizer

        new = {c for x in rows for c in x if self.ask[ord(c)]}
        if new:
            library = Tokenizer.from_file(self.path)
            for c in new:
                self.low[c] = library.normalizer.normalize_str(c)
                for x in {c, *self.low[c]}:
                    if self.ask[ord(x)]:
                        cut = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(f"a{x}{x}")]
                        self.kind[ord(x)] = _LETTER if len(cut) == 1 else _NUMBER if len(cut) == 3 else _NONE if cut == ["a"] else _OTHER
                        self.ask[ord(x)] = False
        return ["".join([self.low.get(c, c.lower()) for c in x]) if any(c in self.low for c in x) else x for x in rows]

    def composed(self, row: str) -> str:
        """The row in NFC, by the library where editions of Unicode differ, and without capital sigmas."""
        form = row if row.isascii() else unicodedata.normalize("NFC", row)
        if any(self.moved[ord(c)] for c in set(form)):
            from tokenizers.normalizers import NFC

            form = NFC().normalize_str(row)
        return form.replace("Σ", "σ")

    def words(self, rows: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Joined normal text, its code points, starts and ends of words, and where each row's words begin."""
        normal = [(x if x.isascii() else unicodedata.normalize("NFC", x).replace("Σ", "σ")).lower() for x in rows]
        joined, points, offsets = code_points(normal)
        if self.rare[points].any():
            joined, points, offsets = code_points([x.lower() for x in self.settle([self.composed(x) for x in rows])])
        kind = self.kind[points]
        n = len(kind)
        if not n:
            zero = np.zeros(0, np.int64)
            return joined, points, zero, zero, np.zeros(len(rows) + 1, np.int64)
        change = np.ones(n + 1, bool)
        change[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        change[offsets[offsets < n]] = True
        edges = np.flatnonzero(change)
        keep = kind[edges[:-1]] != _NONE
        starts, ends = edges[:-1][keep], edges[1:][keep]
        lone = np.flatnonzero((points[starts] == 39) & (ends - starts == 1))
        lone = lone[(lone + 1 < len(starts))]
        lone = lone[(starts[lone + 1] == ends[lone]) & (kind[starts[np.minimum(lone + 1, len(starts) - 1)]] == _LETTER)]
        lone = lone[~np.isin(ends[lone], offsets)]
        if len(lone):
            room = ends[lone + 1] - starts[lone + 1]
            c1 = points[starts[lone + 1]]
            c2 = np.where(room > 1, points[np.minimum(starts[lone + 1] + 1, n - 1)], 0)
            short = np.isin(c1, [ord(c) for c in "stmd"])
            long = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
            take = np.where(short, 1, np.where(long, 2, 0))
            starts, ends = starts.copy(), ends.copy()
            ends[lone] += take
            starts[lone + 1] += take
            full = ends > starts
            starts, ends = starts[full], ends[full]
        return joined, points, starts, ends, np.searchsorted(starts, offsets)

    def parts(self, rows: list[str], special: Callable[[int], object]) -> tuple[list[str], list[list]]:
        """The texts between control strings, and for each row the numbers of its texts with ``special``'s results between."""
        parts: list[str] = []
        plan: list[list] = []
        for text in rows:
            at, mine = 0, []
            for m in self.cut.finditer(text) if self.cut and "<" in text else ():
                mine += [len(parts), special(self.special[m[0]])]
                parts.append(text[at : m.start()])
                at = m.end()
            mine.append(len(parts))
            parts.append(text[at:] if at else text)
            plan.append(mine)
        return parts, plan

    def per_row(self, rows: list[str], memo: Memo, special: Callable[[int], object]) -> Iterator[list]:
        """For each text the memo's results for its words in order; ``special`` gives those of control strings."""
        for a, b in char_chunks(rows):
            parts, plan = self.parts(rows[a:b], special)
            joined, points, starts, ends, at = self.words(parts)
            values: list = []
            inverse = np.zeros(0, np.int64)
            if len(starts):
                index, inverse = distinct(span_hash(prefix_hash(points), starts, ends))
                values = memo.many([joined[s:e] for s, e in zip(starts[index].tolist(), ends[index].tolist(), strict=True)])
            for mine in plan:
                out: list = []
                for k, x in enumerate(mine):
                    if k % 2:
                        out.append(x)
                    else:
                        out += map(values.__getitem__, inverse[at[x] : at[x + 1]].tolist())
                yield out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included: pieces as the vocabulary shows them, with a space between."""
        return " ".join(map(self.shown.__getitem__, ids))


@loaded(2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


@loaded(2)
def digest_memo(path: str) -> Memo:
    c = codec(path)

    def make(words: list[str]) -> list[tuple[str, str, int]]:
        every = map(c.encode_word, words)
        return [(" ".join(map(str, ids)), c.decode(ids), len(ids)) for ids in every]

    return Memo(make, 200_000)


def encode_texts(path: str, rows: list[str]) -> list[list[int]]:
    """Ids of each text."""
    c = codec(path)
    memo = Memo(lambda words: [c.encode_word(w) for w in words])
    return [[i for ids in got for i in ids] for got in c.per_row(rows, memo, lambda i: [i])]


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """One row per document: kept columns, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ids and decoded.

    A null text is encoded as the empty text: no ids, and the digest of nothing. Repeated rows stay.
    """
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

    rows = docs.select(*keep, text)
    schema = StructType([rows.schema[c] for c in keep]).add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType())).add("decoded", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, memo = codec(path), digest_memo(path)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            n, ids, back, all_ids, all_back = [], [], [], [], []
            for got in c.per_row(texts(batch.column(len(keep))), memo, lambda i: (str(i), c.shown[i], 1)):
                shown, decoded = " ".join([x[0] for x in got]), " ".join([x[1] for x in got])
                n.append(sum([x[2] for x in got]))
                ids.append(sha(shown))
                back.append(sha(decoded))
                if with_ids:
                    all_ids.append([int(x) for x in shown.split()])
                    all_back.append(decoded)
            columns = [*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(tidy(run), schema)
