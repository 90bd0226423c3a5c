"""Token provenance from revision texts: which tokens each revision has, where each came from, when it went and came back.

The history of an article is folded in order. A revision's text is cut into paragraphs, sentences and tokens. A paragraph that
the last revision has, or else one that any earlier revision had, keeps its tokens; in what is left the same holds for
sentences; what is still left is aligned token by token with what the last revision has left over. Tokens that nothing matched
are new, and their origin is this revision. A token stands in a revision once: a paragraph or sentence of which another place
has taken a token isn't matched again.

The fold can't be split within an article. Spark deals revisions out by article and sorts them within the partition, and a task
reads them as a stream of batches: it holds one batch of texts, and of the article at hand its tokens and the places of its
distinct paragraphs and sentences, never the texts of its history.

Revisions that look like vandalism are passed over, as if they weren't there: a text of over LONG characters cut by more than
SHRINKS to one below LONG without a comment, a text that was passed over before, or one whose new tokens repeat DENSE times on average.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds for vandalism.
LONG, SHRINKS, DENSE = 1000, 0.4, 20
#: Tokens that are sent on at once.
ROWS = 50_000
#: Places of equal pairs of words that are held at once while two texts are aligned, and stretches from which numpy pays.
MEETINGS, MANY = 1_000_000, 48
#: Beyond MEETINGS, two texts are aligned as one number of at most so many bits.
BITS = 400_000_000
PARAGRAPH_END = re.compile(r"\n[ \t\r\f\v]*\n\s*")
#: White space after a terminal mark, or new lines; it starts with a class, by which places are found sooner.
SENTENCE_END = re.compile(r"\s(?:(?<=[.!?]\s)\s*|(?<=\n)\n*)")
TOKEN = re.compile(r"\w+|\[\[|\]\]|\{\{|\}\}|[^\w\s]")

KINDS = ("state", "life")
#: A state has a row a revision, with lists of its tokens in order; a life has a row a token.
TOKENS = {"ids": pa.int64(), "strs": pa.string(), "origins": pa.int64(), "backs": pa.bool_()}
LIFE = {"token_id": pa.int64(), "str": pa.string(), "o_rev_id": pa.int64(), "ins": pa.list_(pa.int64()), "outs": pa.list_(pa.int64())}
COLUMNS = pa.schema([("kind", pa.string()), ("article", pa.string()), ("rev_id", pa.int64()), *((k, pa.list_(v)) for k, v in TOKENS.items()), *LIFE.items()])
SCHEMA = "kind string, article string, rev_id long, ids array<long>, strs array<string>, origins array<long>, backs array<boolean>, token_id long, str string, o_rev_id long, ins array<long>, outs array<long>"


Sentence = tuple[bytes, list[str]]


def structure(text: str) -> list[list[list[str]]]:
    """Paragraphs of sentences of lower-case tokens; those without a token are left out."""
    return [[tokens for _, tokens in p] for p in _structure(text, {})[0]]


def _structure(text: str, known: dict[str, Sentence]) -> tuple[list[list[Sentence]], dict[str, Sentence]]:
    """structure with each sentence's digest, and all sentences by their text. known: such of another text."""
    found, cut = [], {}
    for part in PARAGRAPH_END.split(text.lower()):
        own = []
        for x in SENTENCE_END.split(part):
            held = known.get(x) or cut.get(x)
            if held is None and (tokens := TOKEN.findall(x)):
                held = _digest(tokens), tokens
            if held:
                cut[x] = held
                own.append(held)
        if own:
            found.append(own)
    return found, cut


def _digest(parts: list[str] | list[bytes]) -> bytes:
    joined = b"".join(parts) if parts and isinstance(parts[0], bytes) else "\0".join(parts).encode("utf-8", "surrogatepass")
    return hashlib.blake2b(joined, digest_size=16).digest()


def _stretches(a: list[int], b: list[int]) -> np.ndarray | None:
    """Columns of start in a, end in a, place in b less that in a: the longest runs of two or more equal words on each diagonal; None if too many places meet."""
    x, y = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    base = int(y.max(initial=0)) + 2
    x, y = np.where((x[:-1] >= 0) & (x[1:] >= 0), x[:-1] * base + x[1:], -1), y[:-1] * base + y[1:]
    order = np.argsort(y, kind="stable")
    first, last = np.searchsorted(y[order], x), np.searchsorted(y[order], x, "right")
    n = last - first
    if (met := int(n.sum())) > MEETINGS:
        return None
    i = np.repeat(np.arange(len(x)), n)
    j = order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(met)]
    key = np.sort((j - i + len(a)) * (len(a) + 1) + i)
    cuts = np.flatnonzero(np.diff(key, prepend=-9) != 1)
    ends = np.append(cuts[1:], len(key)) if len(cuts) else cuts
    start = key[cuts] % (len(a) + 1)
    return np.stack([start, start + ends - cuts + 1, key[cuts] // (len(a) + 1) - len(a)])


def _by_bits(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int]]:
    """matching_blocks of texts whose words repeat often: a bit for each place in a and place in b with the same word, a line of bits for each place in a.

    The number and itself, moved by k lines and k places, have in common where k + 1 words match.
    """
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        wide = (j1 - j0) // 8 + 1  # a bit to spare at least, so that no match goes on in the next line
        places: dict[int, bytearray] = {w: bytearray(wide) for w in set(a[i0:i1])}
        for j in range(j1 - j0):
            if (line := places.get(b[j0 + j])) is not None:
                line[j >> 3] |= 1 << (j & 7)
        cells = int.from_bytes(b"".join([places[w] for w in a[i0:i1]]), "little")
        if not cells:
            continue
        wide *= 8
        twice, n = [cells], 1
        while more := cells & cells >> n * (wide + 1):
            twice.append(cells := more)
            n *= 2
        twice.pop()
        while twice:
            k, step = 1 << len(twice) - 1, twice.pop()
            if more := cells & step >> n * (wide + 1):
                cells = more
                n += k
        i, j = divmod((cells & -cells).bit_length() - 1, wide)  # of the longest, the first in a, then in b
        del cells, more
        yield i0 + i, j0 + j, n
        todo += [x for x in ((i0, i0 + i, j0, j0 + j), (i0 + i + n, i1, j0 + j + n, j1)) if x[0] < x[1] and x[2] < x[3]]


def matching_blocks(old: list[str], new: list[str]) -> Iterator[tuple[int, int, int]]:
    """The blocks of SequenceMatcher(None, old, new, autojunk=False), in any order; neighbouring ones aren't joined.

    The longest block goes first (of equal ones the first in old, then in new), then what lies before and after it. Blocks of
    two words or more come from the runs of equal pairs of words, which are found once; between them single words meet from left to right.
    """
    codes: dict[str, int] = {}
    b = [codes.setdefault(w, len(codes)) for w in new]
    a = [codes.get(w, -1) for w in old]
    runs = _stretches(a, b) if len(a) > 1 and len(b) > 1 else np.empty((3, 0), dtype=np.int64)
    if runs is None and len(a) * (len(b) + 8) <= BITS:
        yield from _by_bits(a, b)
        return
    if runs is None:
        yield from SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks()
        return
    places: dict[int, list[int]] = {}
    todo: list = [(0, len(a), 0, len(b), runs)]
    while todo:
        i0, i1, j0, j1, own = todo.pop()
        if i0 >= i1 or j0 >= j1:
            continue
        if not isinstance(own, list):
            start, end = np.maximum(np.maximum(own[0], i0), j0 - own[2]), np.minimum(np.minimum(own[1], i1), j1 - own[2])
            own = np.stack([start, end, own[2]])[:, end - start > 1]
            if own.shape[1] < MANY:
                own = list(zip(*own.tolist(), strict=True))
            else:
                most = own[:, (own[1] - own[0]) == (own[1] - own[0]).max()]
                most = most[:, most[0] == most[0].min()]
                i, to, d = most[:, most[2].argmin()].tolist()
        if isinstance(own, list):
            within = ((max(s, i0, j0 - d), min(e, i1, j1 - d), d) for s, e, d in own)
            own = [x for x in within if x[1] - x[0] > 1]
            if not own and (i1 - i0) * (j1 - j0) <= MANY:
                for i in range(i0, i1):
                    if a[i] in (rest := b[j0:j1]):
                        j0 += rest.index(a[i]) + 1
                        yield i, j0 - 1, 1
                continue
            if not own:
                if not places:
                    for j, w in enumerate(b):
                        places.setdefault(w, []).append(j)
                for i in range(i0, i1):
                    held = places.get(a[i])
                    if held and (k := bisect_left(held, j0)) < len(held) and held[k] < j1:
                        yield i, held[k], 1
                        j0 = held[k] + 1
                continue
            i, to, d = min(own, key=lambda x: (x[0] - x[1], x[0], x[2]))
        yield i, i + d, to - i
        todo += [(i0, i, j0, i + d, own), (to, i1, to + d, j1, own)]


class Ledger:
    """The tokens of one article and what its last revision holds."""

    def __init__(self, pass_over: bool = True) -> None:
        self.pass_over = pass_over
        self.words: list[str] = []
        self.origins: list[int] = []
        #: Revisions that put tokens back and took them out, of tokens that have some.
        self.ins: dict[int, list[int]] = {}
        self.outs: dict[int, list[int]] = {}
        #: Token ids of each place at which a paragraph or sentence stood, by the digest of its words.
        self.known: dict[bytes, dict[tuple[int, ...], None]] = {}
        #: The last revision: paragraphs as (digest, sentences, token ids), sentences as (digest, token ids).
        self.last: list[tuple[bytes, list[tuple[bytes, tuple[int, ...]]], tuple[int, ...]]] = []
        #: Tokens that the last revision put back.
        self.back: set[int] = set()
        #: Its sentences by their text.
        self.cut: dict[str, Sentence] = {}
        self.size = 0
        self.passed: set[bytes] = set()

    def tokens(self) -> list[int]:
        return [t for _, _, ids in self.last for t in ids]

    def add(self, rev_id: int, text: str, comment: str | None) -> bool:
        """Take a revision; False if it was passed over."""
        whole = _digest([text])
        cut = not (comment or "").strip() and self.size > LONG > len(text) and len(text) < (1 - SHRINKS) * self.size
        if self.pass_over and (cut or whole in self.passed):
            self.passed.add(whole)
            return False
        paragraphs, sentences = _structure(text, self.cut)
        keys = [_digest([d for d, _ in p]) for p in paragraphs]
        used: set[int] = set()
        earlier: list[tuple[int, ...]] = []
        held: list[list[tuple[int, ...] | None]] = [[None] * len(p) for p in paragraphs]
        flat: list[tuple[int, ...] | None] = [None] * len(paragraphs)

        def take(at: int, ids: tuple[int, ...]) -> None:
            held[at], flat[at] = self._cut(ids, paragraphs[at]), ids

        changed = self._match(list(enumerate(range(len(keys)))), keys, [(d, ids) for d, _, ids in self.last], used, earlier, take)
        open_sentences = [(at, k) for at in changed for k in range(len(paragraphs[at]))]
        last = [x for _, own, _ in self.last for x in own if used.isdisjoint(x[1])]
        left = self._match(list(enumerate(open_sentences)), [paragraphs[at][k][0] for at, k in open_sentences], last, used, earlier, lambda at, ids: held[open_sentences[at][0]].__setitem__(open_sentences[at][1], ids))

        gone = [t for t in self.tokens() if t not in used]
        words = [w for at, k in left for w in paragraphs[at][k][1]]
        matched: list[int | None] = [None] * len(words)
        for i, j, n in matching_blocks([self.words[t] for t in gone], words) if gone and words else ():
            matched[j : j + n] = gone[i : i + n]
        stays = set(matched)
        fresh = [w for w, t in zip(words, matched, strict=True) if t is None] if None in stays else []
        if self.pass_over and fresh and len(fresh) / len(set(fresh)) > DENSE:
            self.passed.add(whole)
            return False

        new = len(self.words)
        self.words += fresh
        self.origins += [rev_id] * len(fresh)
        if len(fresh) == len(matched):
            matched = list(range(new, new + len(fresh)))
        elif fresh:
            ids = iter(range(new, new + len(fresh)))
            matched = [next(ids) if t is None else t for t in matched]
        place = 0
        for at, k in left:
            d, own = paragraphs[at][k]
            held[at][k] = ids = tuple(matched[place : place + len(own)])
            place += len(own)
            self.known.setdefault(d, {})[ids] = None
        for at in changed:  # places of the others are known
            flat[at] = ids = tuple(chain.from_iterable(held[at]))
            self.known.setdefault(keys[at], {})[ids] = None
        for t in gone:
            if t not in stays:
                self.outs.setdefault(t, []).append(rev_id)
        self.back = {t for ids in earlier for t in ids}.difference(self.tokens()) if earlier else set()
        for t in self.back:
            self.ins.setdefault(t, []).append(rev_id)
        self.last = [(key, [(d, ids) for (d, _), ids in zip(p, own, strict=True)], ids) for key, p, own, ids in zip(keys, paragraphs, held, flat, strict=True)]
        self.size, self.cut = len(text), sentences
        return True

    @staticmethod
    def _cut(ids: tuple[int, ...], paragraph: list[tuple[bytes, list[str]]]) -> list[tuple[int, ...]]:
        out, place = [], 0
        for _, words in paragraph:
            out.append(ids[place : place + len(words)])
            place += len(words)
        return out

    def _match(self, wanted: list, keys: list[bytes], last: list, used: set[int], earlier: list, take) -> list:
        """Give stretches of the last revision, then earlier ones, to the wanted places in order; returns what is left."""
        here: dict[bytes, list[tuple[int, ...]]] = {}
        for key, ids in last:
            here.setdefault(key, []).append(ids)
        going: dict[bytes, Iterator[tuple[bool, tuple[int, ...]]]] = {}  # what was used once stays used, so that each place is looked at once
        left = []
        for (at, name), key in zip(wanted, keys, strict=True):
            if key not in going:
                going[key] = chain(zip(repeat(True), here.get(key, ())), zip(repeat(False), self.known.get(key, ())))
            now, found = next(((now, ids) for now, ids in going[key] if used.isdisjoint(ids)), (True, None))
            if found is None:
                left.append(name)
            else:
                used.update(found)
                if not now:
                    earlier.append(found)
                take(at, found)
        return left


class _Rows:
    """Rows of both kinds, sent on in batches of about ROWS tokens; states have those of TOKENS in lists."""

    def __init__(self, lists: tuple[str, ...]) -> None:
        self.lists = lists
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple[str, int, int]] = []
        self.tokens: dict[str, list] = {k: [] for k in self.lists}
        self.n_tokens = 0
        self.lives: list[tuple[str, int]] = []
        self.facts: dict[str, list] = {k: [] for k in LIFE}

    def state(self, article: str, rev_id: int, ledger: Ledger) -> Iterator[pa.RecordBatch]:
        ids = ledger.tokens()
        if not ids:
            return
        self.states.append((article, rev_id, len(ids)))
        of = {"ids": lambda: ids, "strs": lambda: map(ledger.words.__getitem__, ids), "origins": lambda: map(ledger.origins.__getitem__, ids), "backs": lambda: map(ledger.back.__contains__, ids)}
        for k, own in self.tokens.items():
            own.extend(of[k]())
        self.n_tokens += len(ids)
        if self.n_tokens >= ROWS:
            yield from self.flush()

    def life(self, article: str | None, newest: int, ledger: Ledger | None) -> Iterator[pa.RecordBatch]:
        n = len(ledger.words) if ledger is not None else 0
        for at in range(0, n, ROWS):
            to = min(at + ROWS, n)
            self.lives += [(article, newest)] * (to - at)
            for k, own in (("token_id", range(at, to)), ("str", ledger.words[at:to]), ("o_rev_id", ledger.origins[at:to])):
                self.facts[k].extend(own)
            for k, own in (("ins", ledger.ins), ("outs", ledger.outs)):
                self.facts[k] += [(t + len(self.lives) - to, own[t]) for t in sorted(own) if at <= t < to]
            if len(self.lives) >= ROWS:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.states:
            articles, revs, sizes = zip(*self.states, strict=True)
            offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
            lists = {k: pa.ListArray.from_arrays(offsets, pa.array(own, TOKENS[k])) for k, own in self.tokens.items()}
            yield self._batch("state", articles, revs, lists)
        if self.lives:
            articles, revs = zip(*self.lives, strict=True)
            yield self._batch("life", articles, revs, {k: self._lists(self.facts[k], len(revs)) if k in ("ins", "outs") else pa.array(self.facts[k], v) for k, v in LIFE.items()})
        self._clear()

    @staticmethod
    def _lists(held: list[tuple[int, list[int]]], n: int) -> pa.ListArray:
        """n lists, of which those that aren't empty are held with their places."""
        sizes = np.zeros(n + 1, np.int32)
        sizes[[at + 1 for at, _ in held]] = [len(x) for _, x in held]
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array([y for _, x in held for y in x], pa.int64()))

    @staticmethod
    def _batch(kind: str, articles: tuple, revs: tuple, columns: dict) -> pa.RecordBatch:
        columns = {"kind": pa.array([kind] * len(revs)), "article": pa.array(articles, pa.string()), "rev_id": pa.array(revs, pa.int64()), **columns}
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(revs), f.type)) for f in COLUMNS], schema=COLUMNS)


def _fold(batches: Iterator[pa.RecordBatch], pass_over: bool, kinds: tuple[str, ...], lists: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches of (article, rev_id, text, comment, wanted), each article's rows together and in order; a repeated revision counts once."""
    out, article, newest, ledger, seen = _Rows(lists), None, 0, None, set()
    for batch in batches:
        names, ids, comments, wanted = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
        for name, rev_id, text, comment, asked in zip(names, ids, batch.column(2), comments, wanted, strict=True):
            if ledger is None or name != article:
                if "life" in kinds:
                    yield from out.life(article, newest, ledger)
                article, ledger, seen = name, Ledger(pass_over), set()
            if rev_id in seen:
                continue
            seen.add(rev_id)
            if ledger.add(rev_id, text.as_py() or "", comment):
                newest = rev_id
                if asked and "state" in kinds:
                    yield from out.state(article, rev_id, ledger)
    if "life" in kinds:
        yield from out.life(article, newest, ledger)
    yield from out.flush()


def _provenance(revisions: DataFrame, targets: DataFrame | None, pass_over: bool, kinds: tuple[str, ...], parts: int | None, lists: tuple[str, ...] = tuple(TOKENS)) -> DataFrame:
    """SCHEMA, of TOKENS those in lists, the others null. Texts are dealt out by article once, into so many parts (None: Spark's own number), and not at all if they are already."""
    ts = F.col("ts") if "ts" in revisions.columns else F.lit(None).cast("timestamp")
    comment = F.col("comment") if "comment" in revisions.columns else F.lit(None)
    rows = revisions.where("article is not null and rev_id is not null").select("article", F.col("rev_id").cast("long").alias("rev_id"), ts.alias("ts"), "text", comment.cast("string").alias("comment"))
    if targets is None:
        rows = rows.withColumn("wanted", F.lit(True))
    else:
        asked = targets.where("rev_id is not null").groupBy("article").agg(F.max("rev_id").cast("long").alias("newest"))
        named = targets.select("article", F.col("rev_id").cast("long").alias("rev_id"), F.lit(True).alias("wanted")).distinct()
        rows = rows.join(asked, "article").where("rev_id <= newest").join(named, ["article", "rev_id"], "left").drop("newest").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    dealt = rows.repartition(parts, "article") if parts else rows.repartition("article")
    ordered = dealt.sortWithinPartitions("article", F.col("ts").asc_nulls_first(), "rev_id")
    return ordered.select("article", "rev_id", "text", "comment", "wanted").mapInArrow(lambda batches: _fold(batches, pass_over, kinds, lists), SCHEMA)


def token_provenance(revisions: DataFrame, targets: DataFrame | None = None, pass_over: bool = True, kinds: tuple[str, ...] = KINDS, parts: int | None = None) -> DataFrame:
    """Token rows of two kinds: `state`, a token at a place of a wanted revision (back: put back by it), and `life`, a token with the revisions that
    put it back (ins) and took it out (outs) up to the newest revision that was read (rev_id).

    revisions: article, rev_id, text and, if known, ts and comment. targets: article, rev_id of the wanted revisions; without
    it all are wanted. Revisions beyond an article's newest target and articles without one aren't read, so that an empty
    table of targets gives nothing. Wanted revisions that were passed over have no row; without pass_over none is. Null texts are empty; a repeated
    revision counts once (the earliest), a null rev_id or article not at all. Revisions go by ts, those without one first, then by rev_id.
    A task sorts the texts of its part, so that parts (see _provenance) should grow in number with the texts.

    Both kinds come from one pass: save the result and read each with states() and lives(), or ask for one of the kinds alone.
    """
    rows = _provenance(revisions, targets, pass_over, kinds, parts)
    if "state" not in kinds:
        return rows.select("kind", "article", "rev_id", F.lit(None).cast("int").alias("place"), "token_id", "str", "o_rev_id", F.lit(None).cast("boolean").alias("back"), "ins", "outs")
    rows = rows.withColumn("t", F.arrays_zip(*TOKENS)).drop(*TOKENS)
    rows = rows.select("*", F.posexplode_outer("t").alias("place", "at")).drop("t")
    own = lambda k, column: F.coalesce(f"at.{k}", column).alias(column)
    return rows.select("kind", "article", "rev_id", "place", own("ids", "token_id"), own("strs", "str"), own("origins", "o_rev_id"), F.col("at.backs").alias("back"), "ins", "outs")


def revision_tokens(revisions: DataFrame, targets: DataFrame | None = None, pass_over: bool = True, parts: int | None = None) -> DataFrame:
    """token_provenance's states with one row a revision: article, rev_id and lists of its tokens' ids, strs, origins and backs in order.

    Revisions without tokens have no row.
    """
    return _provenance(revisions, targets, pass_over, ("state",), parts).select("article", "rev_id", *TOKENS)


def states(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'state'").select("article", "rev_id", "place", "token_id", "str", "o_rev_id")


def lives(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'life'").select("article", "rev_id", "token_id", "str", "o_rev_id", F.col("ins").alias("in"), F.col("outs").alias("out"))


def token_life(facts: DataFrame) -> DataFrame:
    """article, rev_id, token_id, o_rev_id, in, out: the tokens of each wanted revision with all that became of them."""
    return states(facts).select("article", "rev_id", "token_id", "o_rev_id").join(lives(facts).select("article", "token_id", "in", "out"), ["article", "token_id"])


def snapshot_rows(facts: DataFrame, revisions: DataFrame) -> DataFrame:
    """article, snap_date, snap_rev, token_id, o_rev_id of the wanted revisions. revisions: article, rev_id, ts."""
    days = revisions.select("article", "rev_id", F.to_date("ts").alias("snap_date")).distinct()
    return states(facts).join(days, ["article", "rev_id"]).select("article", "snap_date", F.col("rev_id").alias("snap_rev"), "token_id", "o_rev_id")


def origins_of(facts: DataFrame) -> DataFrame:
    """article, rev_id, n_tokens, n_new, n_back, share_kept: what each wanted revision brought, brought back and kept of the wanted one before."""
    n = lambda c: F.count(F.when(c, 1))
    sums = facts.where("kind = 'state'").groupBy("article", "rev_id").agg(F.count(F.lit(1)).alias("n_tokens"), n(F.col("o_rev_id") == F.col("rev_id")).alias("n_new"), n(F.col("back")).alias("n_back"))
    return _kept(sums)


def _kept(sums: DataFrame) -> DataFrame:
    kept = F.col("n_tokens") - F.col("n_new") - F.col("n_back")
    before = F.lag("n_tokens").over(Window.partitionBy("article").orderBy("rev_id"))
    return sums.withColumn("share_kept", kept / before)


def revision_origins(revisions: DataFrame, targets: DataFrame | None = None, pass_over: bool = True, parts: int | None = None) -> DataFrame:
    """origins_of token_provenance's states, counted in each revision's lists without a row a token."""
    rows = _provenance(revisions, targets, pass_over, ("state",), parts, ("origins", "backs"))
    n = lambda c: F.size(c).cast("long")
    return _kept(rows.select("article", "rev_id", n("origins").alias("n_tokens"), n(F.filter("origins", lambda o: o == F.col("rev_id"))).alias("n_new"), n(F.filter("backs", lambda b: b)).alias("n_back")))
