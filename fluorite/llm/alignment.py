"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which tokens overlap, over a corpus.

Both tokenizers cut a text at the start of a run of white space, but for runs that B has in pieces after something else; so
a text is a sequence of units that are encoded alike wherever they stand, and tokens, groups and links never cross units. A task encodes and aligns each unit once, many at a
time: the tokens' ends are cumulative sums of their bytes, common ends are intersected, tokens find their group and the
tokens they overlap by binary search, and links are made by repetition.

Documents go into blocks. A block holds its distinct links once, with the number of its documents that have them; these
numbers are summed in two stages, for each link and salt and then for each link, and what comes out meets the blocks again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A task forgets its units, between blocks, beyond so many, or so many of their characters.
UNITS_KEPT, CHARACTERS_KEPT = 300_000, 8_000_000
#: Characters of the documents of a block; a longer text is a block of its own.
BLOCK = 4_000_000
SALTS = 16
_AT_ONCE, _ENCODED = 500_000, 100_000

#: What the tokenizers call white space, a fixed list of Unicode's.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_MARK = "▁"

_DOCS = "doc array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, held array<long>"
_BLOCK = f"block long, {_DOCS}, place binary, times binary, link array<long>, docs array<long>"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_LINK = 32


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: a byte's own character where that is printable, else
    the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Bytes:
    """Tokenizer A: ids of a text, and each id's bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = _byte_alphabet()
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(n)]
        self.bytes = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in names]

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B, which adds a space: ids of a text, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.tokenizer.get_piece_size()
        names = [self.tokenizer.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(t[3:5], 16)]) if self.tokenizer.is_byte(i) else t.replace(_MARK, " ").encode() for i, t in enumerate(names)]
        #: White space that a piece has after something else: no unit may begin with it.
        self.joining = "".join(c for c in WHITE if any(re.search(f"[^{WHITE}]{c}", t.decode(errors="replace")) for t in self.bytes if len(t) > 1))

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, num_threads=1)


def _expanded(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans from `first` on of n places each: the span of every place, and the place."""
    which = np.repeat(np.arange(len(n)), n)
    return which, first[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]


def align(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the byte lengths of two token sequences over the same bytes: the group of each token of either, and the places
    of the two tokens of each link, in order. Groups end where tokens of both end; tokens link if their bytes overlap."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    first = np.searchsorted(end_b, end_a - len_a, side="right")
    last = np.searchsorted(end_b, end_a)
    link_a, link_b = _expanded(first, last - first + 1)
    return group_a, group_b, link_a, link_b


def _told(names_a: tuple[np.ndarray, list[str]], names_b: tuple[np.ndarray, list[str]], a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Groups as text, "a1,a2|b1;a3|b2", of each unit; `last` is the group after each unit's own. names: of every id its
    digits' number and its text."""
    group, side = np.concatenate([group_a, group_b]), np.repeat([0, 1], [len(a), len(b)])
    order = np.argsort(2 * group + side, kind="stable")
    group, side = group[order], side[order]
    mark = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
    text = [*map(names_a[1].__getitem__, a.tolist()), *map(names_b[1].__getitem__, b.tolist())]
    told = [""] * (2 * len(order))
    told[::2] = map(text.__getitem__, order.tolist())
    told[1::2] = map(",|;".__getitem__, [*mark.tolist(), 2])
    size = np.concatenate([names_a[0][a], names_b[0][b]])[order] + 1
    ends = np.cumsum(size)[np.searchsorted(group, last) - 1].tolist()
    raw = "".join(told).encode()
    return [raw[i : j - 1] for i, j in zip([0, *ends], ends)]


class Units:
    """Units seen by a task, encoded and aligned. numbers: for each, tokens of A and B (-1: no tokens), groups, links."""

    def __init__(self, a: Bytes, b: Pieces):
        self.a, self.b, self.separable = a, b, " " not in b.joining
        more = f"(?:[{b.joining}][{WHITE}]*[^{WHITE}]*)*" if b.joining else ""
        self.pattern = re.compile(f"(?:[{WHITE}]+[^{WHITE}]*|[^{WHITE}]+){more}" if self.separable else "(?s).+")
        self.len_a, self.len_b = (np.array([len(t) for t in x.bytes], dtype=np.int64) for x in (a, b))
        names = [[str(i) for i in range(len(x.bytes))] for x in (a, b)]
        self.names_a, self.names_b = ((np.array([len(n) for n in some]), some) for some in names)
        self.lead_a, self.lead_b = len(a.encode(" x")), len(b.encode("x"))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.told: list[bytes] = []
        self.characters, self.size = 0, 0
        self.numbers = np.zeros((4, 1024), dtype=np.int64)
        self.links = np.zeros(4096, dtype=np.int64)
        self.starts = np.zeros(1025, dtype=np.int64)

    def room(self) -> None:
        """Makes room between blocks, when no code of a unit is in use."""
        if len(self.told) > UNITS_KEPT or self.characters > CHARACTERS_KEPT:
            self.forget()

    def codes(self, units: list[str]) -> np.ndarray:
        """A number for each unit, until units are forgotten."""
        try:
            return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        except KeyError:
            self.learn([u for u in dict.fromkeys(units) if u not in self.known])
            return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def learn(self, units: list[str]) -> None:
        some: list[str] = []
        held = 0
        for u in units:
            if not self.separable or len(u) > _ENCODED or u[-1].isspace() or _MARK in u:
                self._take([u])  # as it may run into the next one
                continue
            some.append(u)
            held += len(u)
            if held > _ENCODED:
                self._take(some)
                some, held = [], 0
        if some:
            self._take(some)

    def _encode(self, text: str) -> tuple[list[int], list[int], bool]:
        """Ids of a text by both, and whether both give its bytes back. A first word, an x, takes the space that B adds."""
        raw = text.encode()
        if self.separable:
            a, b = self.a.encode(" x" + text)[self.lead_a :], self.b.encode("x" + text)[self.lead_b :]
        else:
            a, b = self.a.encode(text), self.b.encode(text[1:])
        return a, b, b"".join(map(self.a.bytes.__getitem__, a)) == raw == b"".join(map(self.b.bytes.__getitem__, b))

    def _take(self, units: list[str]) -> None:
        a, b, same = self._encode("".join(units))
        size = np.array([len(u.encode()) for u in units])
        ends = np.cumsum(size)
        if same:
            a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
            end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
            same = bool(np.isin(ends, end_a).all() and np.isin(ends, end_b).all())
        if not same:
            if len(units) > 1:
                for u in units:
                    self._take([u])
            else:
                self._put(units, np.full((4, 1), -1), np.zeros(2, dtype=np.int64), np.zeros(0, dtype=np.int64), [b""])
            return
        cut_a, cut_b = np.searchsorted(end_a, ends) + 1, np.searchsorted(end_b, ends) + 1
        group_a, group_b, link_a, link_b = align(self.len_a[a], self.len_b[b])
        link_ends = np.searchsorted(link_a, cut_a)
        group_ends = group_a[cut_a - 1] + 1
        numbers = np.array([np.diff(x, prepend=0) for x in (cut_a, cut_b, group_ends, link_ends)])
        told = _told(self.names_a, self.names_b, a, b, group_a, group_b, group_ends)
        self._put(units, numbers, np.r_[0, link_ends], a[link_a] << _LINK | b[link_b], told)

    def _put(self, units: list[str], numbers: np.ndarray, starts: np.ndarray, links: np.ndarray, told: list[bytes]) -> None:
        at, n = len(self.told), len(units)
        while at + n > self.numbers.shape[1]:
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)], axis=1)
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.size + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.numbers[:, at : at + n] = numbers
        self.starts[at : at + n + 1] = self.size + starts
        self.links[self.size : self.size + len(links)] = links
        self.size += len(links)
        self.told += told
        self.known.update(zip(units, range(at, at + n)))
        self.characters += sum(map(len, units))


class Block:
    """Documents of a block so far: numbers and hash of each, and the links (document, link, times) that they hold."""

    def __init__(self, units: Units):
        self.units, self.docs, self.characters = units, [], 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting: list[np.ndarray] = []
        self.n = 0  # units that wait

    def add(self, doc: int | None, text: str | None, parts: list[str] | None = None) -> None:
        """A text's units, which may be given, are turned into numbers, many at a time; they wait until many documents can
        be counted at once."""
        u, total, sha, whole = self.units, np.zeros(4, dtype=np.int64), hashlib.sha256(), bool(text)
        if text:
            self.characters += len(text)
            found = u.pattern.finditer(" " + text) if len(text) > BLOCK else None
            more = iter([parts or u.pattern.findall(" " + text)]) if found is None else iter(lambda: [m.group() for m in islice(found, _AT_ONCE)], [])
            first = True
            for some in more:
                codes = u.codes(some)
                numbers = u.numbers[:, codes]
                whole = whole and bool((numbers[0] >= 0).all())
                if not whole:
                    break
                total += numbers.sum(axis=1)
                sha.update((b"" if first else b";") + b";".join(map(u.told.__getitem__, codes.tolist())))
                first = False
                self.waiting.append(np.stack([np.full(len(codes), len(self.docs)), codes]))
                self.n += len(codes)
                if found is not None:
                    self.count()
                    u.room()
        if not whole:
            self.waiting = [w for w in self.waiting if w[0, 0] != len(self.docs)]
            self.parts = [tuple(x[p[0] != len(self.docs)] for x in p) for p in self.parts]
        self.docs.append((doc, *(total.tolist() if whole else (0, 0, 0, 0)), sha.hexdigest() if whole else ""))
        if self.n > _AT_ONCE:
            self.count()

    def count(self) -> None:
        """Links of the units that wait: units are counted for each document first, then expanded."""
        if not self.waiting:
            return
        doc, code = np.concatenate(self.waiting, axis=1)
        self.waiting, self.n = [], 0
        u, width = self.units, len(self.units.told)
        key, times = np.unique(doc * width + code, return_counts=True)
        doc, code = np.divmod(key, width)
        which, place = _expanded(u.starts[code], u.starts[code + 1] - u.starts[code])
        self.parts.append(_summed(doc[which], u.links[place], times[which]))
        if len(self.parts) > 8:
            self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts)))]

    def row(self, number: int) -> pa.RecordBatch:
        self.count()
        doc, link, times = _summed(*(np.concatenate(x) for x in zip(*self.parts))) if self.parts else (np.zeros(0, dtype=np.int64),) * 3
        distinct, place, docs = np.unique(link, return_inverse=True, return_counts=True)
        held = np.bincount(doc, minlength=len(self.docs))
        columns = [*map(list, zip(*self.docs)), held.tolist()]
        cells = [pa.array([number], pa.int64()), *[pa.array([c], pa.list_(pa.string() if i == 5 else pa.int64())) for i, c in enumerate(columns)]]
        cells += [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (place, times)]
        cells += [pa.array([x], pa.list_(pa.int64())) for x in (distinct, docs)]
        names = [c.strip().split(" ")[0] for c in _BLOCK.split(",")]
        return pa.RecordBatch.from_arrays(cells, names=names)


def _summed(doc: np.ndarray, link: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same sorted by document and link, with one row for each."""
    if not len(doc):
        return doc, link, times
    distinct, place = np.unique(link, return_inverse=True)
    key, at = np.unique(doc * len(distinct) + place, return_inverse=True)
    return key // len(distinct), distinct[key % len(distinct)], np.bincount(at, weights=times).astype(np.int64)


def blocks(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """docs (doc_id, text) encoded and aligned, in blocks."""
    import public_tokenizers

    path_a, path_b = path_a or public_tokenizers.path(BYTES), path_b or public_tokenizers.path(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        units, number = Units(Bytes(path_a), Pieces(path_b)), TaskContext.get().partitionId() << 32
        held = Block(units)

        def rows(batches) -> Iterator[tuple[int | None, str | None, list[str] | None]]:
            """Documents and their units; those of some documents are learned at once."""
            some, new, characters = [], {}, 0
            for batch in batches:
                for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    try:
                        text = raw.as_py().decode() if raw.is_valid else None
                    except UnicodeDecodeError:
                        text = None  # no tokens can give its bytes back
                    parts = units.pattern.findall(" " + text) if text and len(text) <= _AT_ONCE else None
                    some.append((doc, text, parts))
                    new.update(dict.fromkeys(parts or ()))
                    characters += len(text or "")
                    if characters > _AT_ONCE or len(some) > 20_000:
                        units.learn([u for u in new if u not in units.known])
                        yield from some
                        some, new, characters = [], {}, 0
            units.learn([u for u in new if u not in units.known])
            yield from some

        for doc, text, parts in rows(batches):
            held.add(doc, text, parts)
            if held.characters > BLOCK or len(held.docs) > BLOCK // 100:
                yield held.row(number)
                number += 1
                units.room()
                held = Block(units)
        if held.docs:
            yield held.row(number)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, _BLOCK)


def link_counts(made: DataFrame, salts: int = SALTS) -> DataFrame:
    """(link, salt, docs, best): of blocks, for each link and each salt it has, in how many documents it is, and whether no
    other link of its A id is in more. Summed in two stages, so that a link of every block isn't one task's."""
    salt = F.pmod(F.hash("block"), F.lit(salts)).alias("salt")
    each = made.select(salt, F.inline(F.arrays_zip("link", "docs"))).groupBy("link", "salt").agg(F.sum("docs").alias("docs"))
    each = stored(each)
    total = each.groupBy("link").agg(F.sum("docs").alias("docs"))
    a = F.shiftright("link", _LINK)
    most = total.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    judged = total.withColumn("a", a).join(most, "a").select("link", "docs", (F.col("docs") == F.col("most")).alias("best"))
    return each.select("link", "salt").join(judged, "link")


def digest(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, salts: int = SALTS) -> DataFrame:
    """For each row of docs (doc_id, text): n_a and n_b tokens, n_groups, n_links, n_best (links whose number of documents
    is the highest of their A id), count_sum (those numbers over all links), groups_sha256.

    The text has a space before it, and special tokens' strings in it are text. Null and empty texts, and texts that the
    tokens of A or B don't give back byte by byte, have no tokens: zeros and an empty hash. Rows of a null or repeated
    doc_id are documents each; an empty table gives none; other columns are ignored.
    """
    made = stored(blocks(docs, path_a, path_b))
    counts = link_counts(made, salts)
    asked = made.select(F.col("block").alias("of"), F.pmod(F.hash("block"), F.lit(salts)).alias("salt"), F.posexplode("link").alias("at", "link"))
    answers = asked.join(counts, ["link", "salt"]).select("of", "at", "docs", "best")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        at, docs_, best = (right.column(c).to_numpy() for c in ("at", "docs", "best"))
        n, good = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        n[at], good[at] = docs_, best
        row = left.to_pylist()[0]
        place, times = (np.frombuffer(row[c], dtype="<u4").astype(np.int64) for c in ("place", "times"))
        ahead = [np.concatenate([[0], np.cumsum(x[place] * times)]) for x in (good, n)]
        ends = np.cumsum(row["held"])
        sums = [(x[ends] - x[ends - np.array(row["held"], dtype=np.int64)]) for x in ahead]
        columns = [row["doc"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *sums, row["sha"]]
        return pa.table([pa.array(c, pa.string() if i == 7 else pa.int64()) for i, c in enumerate(columns)], names=[c.split(" ")[0] for c in _OUT.split(", ")])

    return made.drop("link", "docs").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(judge, _OUT)


def groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, groups): each text's groups with their ids, "a1,a2|b1;a3|b2,b3"; null for texts without tokens."""
    import public_tokenizers

    path_a, path_b = path_a or public_tokenizers.path(BYTES), path_b or public_tokenizers.path(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(Bytes(path_a), Pieces(path_b))
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                units.room()
                codes = units.codes(units.pattern.findall(" " + text)) if text else []
                found.append(b";".join([units.told[c] for c in codes]) if text and (units.numbers[0, codes] >= 0).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()).cast(pa.string())], names=["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, groups string")


def links(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(a, b, docs, best): ids of A and B whose tokens overlap somewhere, in how many documents, and whether no B id is
    linked with this A id in more."""
    found = link_counts(stored(blocks(docs, path_a, path_b))).select("link", "docs", "best").distinct()
    return found.select(F.shiftright("link", _LINK).alias("a"), F.col("link").bitwiseAND((1 << _LINK) - 1).alias("b"), "docs", "best")
