"""Operator 2: toxicity by a support vector machine with a subsequence string kernel.

The kernel of two strings counts common subsequences of ``order`` characters, each weighted
down by the gaps it spans, so a string with inserted characters, blanks or an ending stays
close to the one it hides; a string shorter than ``order`` is compared by subsequences of its
own length. Strings that toxic documents hold far oftener than others are the seeds of the
Nyström landmarks. The commonest windows of labelled documents near such a seed, of either
class, are landmarks too. The machine learns from all these windows: one is toxic if toxic documents
hold it far oftener, and so is each with a character put into it (a virtual example), unless
clean documents hold that string too.

A sentence is read through windows that can hold a landmark: each word without its signs, in
overlapping parts if it is long; runs of single characters, joined; and two neighbouring words
with their blank, where a landmark may reach across it, as the first ends with its beginning and
the second begins with the rest. A document is as toxic as its worst window. A logistic curve turns the margin into a
score; it passes ``cut_score`` where labelled documents are told apart best.

A window is compared with the landmarks with which it shares three pairs of neighbouring
characters; others count as unlike. Each window is read once for as long as a task remembers it. Models are fitted on a
sample of labelled documents bounded by ``Settings``.

Defined cases: null and empty texts hold no sentence and get the lowest margin of the training
sample; without labels of both classes every score is the share of toxic labels (0 without
any); repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.native import let
from reviewlens.session import stage

WINDOW = 24
_ENDS = b".,;:!?\"'()[]{}<>*#$%&|_-=+/\\~`^"
_SENTENCE_ENDS = (b".", b"!", b"?", b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f")


@dataclass(frozen=True)
class Settings:
    order: int = 4
    decay: float = 0.7
    #: The kernel is raised to this power, which keeps it one and sharpens it.
    power: int = 4
    seeds: int = 32
    landmarks: int = 128
    #: Bound of the sample of labelled documents that are read to learn.
    sample_documents: int = 20_000
    #: Strings that are tried as landmarks and windows that are learned from, the commonest first.
    tried_strings: int = 50_000
    near_windows: int = 8000
    #: Clean documents that are looked at first, to leave out strings which are common there.
    first_clean: int = 1000
    near: float = 0.7
    #: How much oftener toxic documents hold a landmark: of up to three characters, and longer.
    short_rate: float = 60
    long_rate: float = 8
    #: And a window that counts as toxic.
    toxic_rate: float = 20
    cut_score: float = 0.7
    cache_words: int = 500_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def plain(word: bytes) -> str:
    return word.translate(None, _ENDS).decode("utf-8", "replace")


def windows_of(word: str) -> list[str]:
    """The word between its blanks, or overlapping parts of a long one."""
    word, half = f" {word} ", WINDOW // 2
    return [word[at : at + WINDOW] for at in range(0, max(len(word) - half, 1), half)]


def spelled(words: list[bytes]) -> list[str]:
    """Runs of three or more single characters, joined."""
    out, run = [], []
    for word in [*map(plain, words), ""]:
        if len(word) == 1:
            run.append(word)
            continue
        if len(run) > 2:
            out.append("".join(run))
        run = []
    return out


def kernel(words: list[str], others: list[str], order: int, decay: float) -> np.ndarray:
    """Gap-weighted subsequence kernel of all ``words`` with all ``others``, for words of about one
    length at a time. Divided by the value of ``others`` with themselves, so a word that holds
    the other string unbroken gets 1 or a little more."""
    out = np.zeros((len(words), len(others)), np.float32)
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        # filled up to few lengths, so that few calls do for all words
        by_length.setdefault(-(-len(w) // 6) * 6, []).append(k)
    targets = [_codes(other) for other in others]
    orders = [max(min(order, len(t)), 1) for t in targets]
    own = [_kernel_column(t[:, None].copy(), t, o, decay)[0] if len(t) else 1.0 for t, o in zip(targets, orders)]
    seeds = _pairs_table(targets)
    for n, at in by_length.items():
        for low in range(0, len(at) if n else 0, 16_384):
            chosen = np.array(at[low : low + 16_384])
            s = _codes("".join([words[k].ljust(n, _FILL) for k in chosen])).reshape(len(chosen), n)
            s = np.ascontiguousarray(s.T)
            close = _sharing(s, seeds, targets)
            for j, t in enumerate(targets):
                if 0 < len(t) and orders[j] <= n:
                    hit = np.flatnonzero(close[:, j // 64] >> np.uint64(j % 64) & np.uint64(1))
                    if len(hit):
                        out[chosen[hit], j] = _kernel_column(s[:, hit], t, orders[j], decay) / own[j]
    return out


_PAIRS = 1 << 14
#: Fills words up to a length; no text holds it.
_FILL = "\U0010fffe"


def _pair_codes(s: np.ndarray) -> np.ndarray:
    return (s[:-1].astype(np.int64) * 1009 + s[1:]) % _PAIRS


def _pairs_table(targets: list[np.ndarray]) -> np.ndarray:
    """For each pair of neighbouring characters the targets that have it, as bits."""
    out = np.zeros((_PAIRS, len(targets) // 64 + 1), np.uint64)
    for j, t in enumerate(targets):
        out[_pair_codes(t), j // 64] |= np.uint64(1 << j % 64)
    return out


def _sharing(s: np.ndarray, seeds: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """For each column the targets that share three pairs of neighbours with it, or all of theirs
    if they have fewer."""
    counts = [np.zeros((s.shape[1], seeds.shape[1]), np.uint64) for _ in range(3)]
    for codes in _pair_codes(s):
        bits = seeds[codes]
        for more, fewer in ((2, 1), (1, 0)):
            counts[more] |= counts[fewer] & bits
        counts[0] |= bits
    out = counts[2]
    for j, t in enumerate(targets):
        if len(t) < 4:
            bit = np.uint64(1 << j % 64)
            out[:, j // 64] |= counts[len(t) - 2][:, j // 64] & bit if len(t) > 1 else bit
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def _reach(n: int, decay: float) -> np.ndarray:
    """Weights by which each place sums up what ends at earlier places."""
    gap = np.arange(n)[:, None] - np.arange(n)[None, :]
    return np.where(gap > 0, float(decay) ** gap, 0).astype(np.float32)


#: Strings worked out at once, so that what is held of them stays in the processor's cache.
_COLUMNS = 256


def _kernel_column(s: np.ndarray, t: np.ndarray, order: int, decay: float) -> np.ndarray:
    """``s`` holds a string per column."""
    n, m = len(s), len(t)
    # the last matched character adds its decay in each string, the gaps before it the rest
    along_s, along_t = _reach(n, decay), _reach(m, decay)
    out = np.empty(s.shape[1], np.float32)
    for low in range(0, s.shape[1], _COLUMNS):
        same = (s[:, None, low : low + _COLUMNS] == t[None, :, None]).astype(np.float32)
        width = same.shape[2]
        # ends[i, j]: weight of the subsequences whose last characters match at i and j
        ends = same * np.float32(decay * decay)
        for _ in range(order - 1):
            # sums over all earlier pairs of places, weighted by the gaps up to here
            reach = np.matmul(along_t, ends)
            reach = np.matmul(along_s, reach.reshape(n, m * width)).reshape(n, m, width)
            ends = np.multiply(same, reach, out=reach)
        out[low : low + width] = ends.sum(axis=(0, 1))
    return out


@dataclass
class Model:
    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    lowest: float = 0.0
    constant: float | None = None
    settings: Settings = Settings()

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word: that of its worst window."""
        windows = [windows_of(w) for w in words]
        flat = [u for us in windows for u in us]
        if not flat:
            return np.empty(0)
        at = kernel(flat, self.landmarks, self.settings.order, self.settings.decay)
        margin = at**self.settings.power @ self.weights + self.bias
        return np.maximum.reduceat(margin, np.cumsum([0] + [len(us) for us in windows[:-1]]))

    def score(self, margin: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(margin), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


class Reader:
    """Margins of texts; remembers the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        #: A bit for each place where a landmark can be cut in two.
        inner = [l.strip() for l in model.landmarks]
        cuts = list(dict.fromkeys((l[:k], l[k:]) for l in inner for k in range(2, len(l) - 1)))
        self.heads: dict[str, list[int]] = {}
        self.tails: dict[str, list[int]] = {}
        for bit, (head, tail) in enumerate(cuts):
            self.heads.setdefault(head, []).append(bit)
            self.tails.setdefault(tail, []).append(bit)
        #: Lengths of the heads by their last two characters, and of the tails by their first two.
        self.head_ends: dict[str, set[int]] = {}
        self.tail_starts: dict[str, set[int]] = {}
        for head in self.heads:
            self.head_ends.setdefault(head[-2:], set()).add(len(head))
        for tail in self.tails:
            self.tail_starts.setdefault(tail[:2], set()).add(len(tail))
        self.width = len(cuts) // 64 + 1
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.margin = np.empty(0)
        self.single = np.empty(0, bool)
        self.ending = np.empty((0, self.width), np.uint64)
        self.beginning = np.empty((0, self.width), np.uint64)

    def _bits(self, words: list[str], last: bool) -> np.ndarray:
        """The cuts whose head a word ends with, or whose tail it begins with."""
        out = np.zeros((len(words), self.width), np.uint64)
        of, ends = (self.heads, self.head_ends) if last else (self.tails, self.tail_starts)
        for row, word in enumerate(words):
            for n in ends.get(word[-2:] if last else word[:2], ()):
                if n <= len(word):
                    for bit in of.get(word[-n:] if last else word[:n], ()):
                        out[row, bit // 64] |= np.uint64(1 << bit % 64)
        return out

    def learn(self, texts: list[list[bytes]]) -> None:
        new = {w for w in set().union(*texts) if w not in self.known}
        if len(self.known) + len(new) > self.model.settings.cache_words:
            self.forget()
            new = set().union(*texts)
        if not new:
            return
        words = [plain(w) for w in new]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        # many words differ in their signs alone
        place = {w: k for k, w in enumerate(dict.fromkeys(words))}
        distinct = list(place)
        of = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        open_end = np.array([not raw.endswith(_SENTENCE_ENDS) for raw in new])
        self.margin = np.append(self.margin, self.model.margins(distinct)[of])
        self.single = np.append(self.single, np.array([len(w) == 1 for w in distinct])[of])
        ending = self._bits(distinct, True)[of] * open_end[:, None].astype(np.uint64)
        self.ending = np.concatenate([self.ending, ending])
        self.beginning = np.concatenate([self.beginning, self._bits(distinct, False)[of]])

    def worst(self, texts: list[list[bytes]]) -> list[float]:
        """The highest margin in each text, given as its words."""
        self.learn(texts)
        out, more = [], []
        for words in texts:
            ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            out.append(float(self.margin[ids].max()) if words else self.model.lowest)
            one = self.single[ids]
            joined = spelled(words) if (one[2:] & one[1:-1] & one[:-2]).any() else []
            across = (self.ending[ids[:-1]] & self.beginning[ids[1:]]).any(axis=1)
            more.append(joined + [f"{plain(words[k])} {plain(words[k + 1])}" for k in np.flatnonzero(across)])
        new = list({w for found in more for w in found})
        margin = dict(zip(new, self.model.margins(new).tolist()))
        return [max([m, *[margin[w] for w in found]]) for m, found in zip(out, more)]


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss and classes of equal weight, by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y < 0].sum()) * cost * 100
    w = np.zeros(z.shape[1])
    keep = np.eye(z.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(30):
        slack = 1 - y * (z @ w)
        active = slack > 0
        za, sa = z[active], share[active]
        gradient = keep @ w - 2 * za.T @ (sa * y[active] * slack[active])
        step = np.linalg.solve(keep + 2 * (za * sa[:, None]).T @ za, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _curve(margin: np.ndarray, toxic: np.ndarray, score: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve that passes ``score`` at the margin from which documents
    count as toxic: of all margins whose share of toxic documents found, less six times the share
    of others, is about the best, the lowest, so that changed strings still pass."""
    cuts = np.unique(margin)
    found = [1 - np.searchsorted(np.sort(margin[toxic == y]), cuts) / max((toxic == y).sum(), 1) for y in (1, 0)]
    gain = found[0] - 6 * found[1]
    best = int(np.flatnonzero(gain >= gain.max() - 0.005)[0])
    # between this margin and the one below it
    cut = (cuts[best] + cuts[best - 1]) / 2 if best else cuts[0]
    spread = np.median(margin[margin >= cut]) - np.median(margin[margin < cut]) if best else 1.0
    slope = 4 / max(float(spread), 1e-3)
    return slope, float(np.log(score / (1 - score)) - slope * cut)


def _pieces(word: str) -> set[bytes]:
    """Strings of 2 to 10 characters of a word and the blanks around it."""
    word, out = f" {word} ", set()
    for n in range(2, min(len(word), 10) + 1):
        out.update(word[at : at + n].encode() for at in range(len(word) - n + 1))
    return {p for p in out if len(p.strip()) > 1}


def _counted_pieces(docs: DataFrame, only: set[bytes] | None) -> DataFrame:
    """Documents that hold each string of their words (all, or ``only`` some), counted per partition first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        known: dict[bytes, tuple[bytes, ...]] = {}
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                words = set((text.as_py() or b"").lower().split())
                if len(known) > 200_000:
                    known.clear()
                # not words - known.keys(), which would go through all known words
                for word in [w for w in words if w not in known]:
                    found = _pieces(plain(word))
                    known[word] = tuple(found if only is None else found & only)
                counts.update(set(chain.from_iterable(map(known.__getitem__, words))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            names=["piece", "n"],
        )

    return (
        docs.select("text").mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    )


def choose_landmarks(toxic: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int, settings: Settings) -> list[str]:
    least = max(3, n_toxic // 500)
    often = (
        _counted_pieces(toxic, None)
        .filter(F.col("n") >= least)
        .orderBy(F.desc("n"), "piece")
        .limit(settings.tried_strings)
        .collect()
    )
    of_toxic = {bytes(r["piece"]): r["n"] for r in often}
    # strings that some clean documents already show to be common are not counted in the others
    mark = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1 << 20))
    share = min(1.0, settings.first_clean / max(n_clean, 1))
    some = clean.filter(mark < int(share * (1 << 20)))
    first = {bytes(r["piece"]): r["n"] for r in _counted_pieces(some, set(of_toxic)).collect()}
    common = {p for p, n in first.items() if n > 8 and n / (share * n_clean) > of_toxic[p] / n_toxic}
    only = of_toxic.keys() - common
    of_toxic = {p: n for p, n in of_toxic.items() if p in only}
    of_clean = {bytes(r["piece"]): r["n"] for r in _counted_pieces(clean, set(only)).collect()}
    rates = {
        p: (n / n_toxic) / ((of_clean.get(p, 0) + 0.5) / max(n_clean, 1)) for p, n in of_toxic.items()
    }
    # how unlikely so many are by chance, against the number of pieces looked at
    surprise = 2 * np.log(max(len(of_toxic), 1)) + 4
    prior = n_toxic / (n_toxic + n_clean)

    def gain(p: bytes) -> float:
        a, b = of_toxic[p], of_clean.get(p, 0)
        other = b * np.log(b / ((a + b) * (1 - prior))) if b else 0.0
        return 2 * (a * np.log(a / ((a + b) * prior)) + other)

    def rate(p: bytes) -> float:
        return settings.short_rate if len(p.decode("utf-8", "replace")) < 4 else settings.long_rate

    marked = {p: n for p, n in of_toxic.items() if rates[p] >= rate(p) and gain(p) >= surprise}
    # the strings that hold a marked one, found through all parts of each
    around: dict[bytes, list[bytes]] = {}
    for p in marked:
        parts = {p[a:b] for a in range(len(p)) for b in range(a + 1, len(p) + 1)} - {p}
        for part in parts & marked.keys():
            around.setdefault(part, []).append(p)
    chosen: list[bytes] = []
    # the longest piece that is still nearly as frequent stands for its parts
    for piece in sorted(marked, key=lambda p: (-marked[p], -len(p), p)):
        longer = [p for p in around.get(piece, []) if marked[p] >= 0.9 * marked[piece]]
        if longer or any(piece in c or c in piece for c in chosen):
            continue
        chosen.append(piece)
        if len(chosen) == settings.seeds:
            break
    return [c.decode("utf-8", "replace") for c in chosen]


def near_windows(docs: DataFrame, landmarks: list[str], settings: Settings) -> DataFrame:
    """``window, toxic, n``: windows of ``docs`` (text, toxic) near a landmark, with the documents
    of each class that have them, counted per partition first."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[bytes, set[str]] = {}
        counts: dict[tuple[str, int], int] = {}
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            for low, high in grouped(batch.column(0)):
                texts = batch.column(0).slice(low, high - low).cast(pa.binary())
                found = [set((t.as_py() or b"").lower().split()) for t in texts]
                new = [w for w in set().union(*found) if w not in near]
                cut = [windows_of(plain(w)) for w in new]
                flat = list({u for us in cut for u in us})
                if flat:
                    at = kernel(flat, landmarks, settings.order, settings.decay).max(axis=1)
                    close = {u for u, k in zip(flat, at) if k >= settings.near}
                    near.update((w, close.intersection(us)) for w, us in zip(new, cut))
                for row, words in enumerate(found):
                    for window in set().union(*[near[w] for w in words]):
                        key = window, toxic[low + row]
                        counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([w for w, _ in counts], pa.string()),
                pa.array([t for _, t in counts], pa.int32()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            names=["window", "toxic", "n"],
        )

    found = docs.select("text", F.col("toxic").cast("int").alias("toxic"))
    return (
        found.mapInArrow(find, "window string, toxic int, n long")
        .groupBy("window")
        .agg(*[F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(n) for y, n in ((1, "bad"), (0, "good"))])
        .orderBy(F.desc(F.col("bad") + F.col("good")), "window")
        .limit(settings.near_windows)
    )


def with_insertions(window: str) -> list[str]:
    """The window with a character or a blank between two of its own, not beside its blanks."""
    return [window[:k] + c + window[k:] for k in range(2, len(window) - 1) for c in "xo1 "]


def sampled(labels: DataFrame, settings: Settings) -> tuple[DataFrame, int, int]:
    """A sample of ``labels`` (doc_id, toxic), at most about ``sample_documents``, and how many
    labels of all and of toxic documents there are."""
    counts = labels.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    mark = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 20))
    share = min(1.0, settings.sample_documents / max(counts["n"], 1))
    return labels.filter(mark < int(share * (1 << 20))), counts["n"], counts["toxic"] or 0


def near_copy_key(text: Column) -> Column:
    """Four min-hashes of the runs of five words; the text's hash when it has none."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def least(runs: Column) -> Column:
        return F.array(*[F.array_min(F.transform(runs, lambda h, k=k: F.xxhash64(h, F.lit(k)))) for k in range(4)])

    def key(ws: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(ws) - 4, F.lit(1)))
        runs = F.transform(places, lambda i: F.xxhash64(F.slice(ws, i, F.lit(5))))
        alone = F.array(*[F.xxhash64(text, F.lit(k)) for k in range(4)])
        return F.when(F.size(ws) >= 5, let(runs, least)).otherwise(alone)

    return let(words, key)


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """From ``docs`` (doc_id, text) and their ``labels`` (doc_id, toxic: 0 or 1)."""
    model = Model(settings=settings)
    asked, n, n_toxic = sampled(labels, settings)
    if n_toxic in (0, n):
        model.constant = n_toxic / n if n else 0.0
        return model
    asked = asked.withColumnRenamed("doc_id", "_labelled")
    # the sample is bounded, so it may be sent to the tasks that read the texts
    found = docs.join(F.broadcast(asked), F.col("doc_id") == F.col("_labelled"))
    # near copies would make chance words of a text look frequent; texts are seldom alike in 4 of
    # 5 runs of words and differ in all four of the least hashes
    keyed = found.select("doc_id", "text", "toxic", near_copy_key(F.col("text")).alias("key"))
    for k in range(4):
        keyed = keyed.withColumn("one", F.get("key", F.lit(k))).dropDuplicates(["one", "toxic"])
    sample = stage(keyed.drop("key", "one"), "toxicity-sample")
    share_toxic = n_toxic / n
    toxic, clean = sample.filter("toxic = 1"), sample.filter("toxic = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    model.landmarks = choose_landmarks(toxic, clean, max(n_toxic, 1), n_clean, settings)
    if not model.landmarks or not n_clean:
        model.landmarks, model.constant = [], share_toxic
        return model
    near = near_windows(sample, model.landmarks, settings).collect()
    n_bad, n_good = max(n_toxic, 1), max(n_clean, 1)
    bad = {r["window"] for r in near if r["bad"] / n_bad >= settings.toxic_rate * (r["good"] + 0.5) / n_good}
    good = {r["window"] for r in near} - bad
    # the seeds only led here; whole windows tell their neighbours apart
    half = settings.landmarks // 2
    often = [[r["window"] for r in near if r["window"] in side and r["bad"] + r["good"] > 1] for side in (bad, good)]
    model.landmarks = often[0][:half] + often[1][:half] or model.landmarks
    # a window counts as often as documents of its class have it, its changed forms together half
    weight = {r["window"]: float(r["bad"] if r["window"] in bad else r["good"]) for r in near}
    for window in sorted(bad):
        changed = with_insertions(window)
        for form in changed:
            weight.setdefault(form, weight[window] / (2 * len(changed)))
    bad = set(weight) - good
    words = sorted(bad | good)
    if not bad:
        model.landmarks, model.constant = [], share_toxic
        return model
    if not good:
        words.append("")
    y = np.array([1.0 if w in bad else -1.0 for w in words])
    gram = kernel(model.landmarks, model.landmarks, settings.order, settings.decay).astype(float)
    gram = ((gram + gram.T) / 2) ** settings.power
    values, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6 * values.max()))) @ vectors.T
    x = kernel(words, model.landmarks, settings.order, settings.decay).astype(float)
    x = x**settings.power @ root
    w, model.bias = _fit(x, y, np.array([weight.get(window, 1.0) for window in words]))
    model.weights = (root @ w).astype(np.float32)
    model.lowest = float(min((x @ w + model.bias).min(), model.bias))
    seen = scored(sample.select("doc_id", "text", "toxic"), model, ["toxic"]).select("margin", "toxic").toArrow()
    model.slope, model.offset = _curve(
        seen.column("margin").to_numpy(), seen.column("toxic").to_numpy(), settings.cut_score
    )
    return model


def grouped(texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Neighbouring rows that hold about ``most`` bytes together, as (first, past the last)."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield low, high
        low = high


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` with ``margin`` and ``score`` of each row's text."""
    schema = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for low, high in grouped(batch.column(len(keep))):
                part = batch.slice(low, high - low)
                texts = [
                    (t.as_py() or b"").lower().split() if model.constant is None else []
                    for t in part.column(len(keep)).cast(pa.binary())
                ]
                margin = np.array(reader.worst(texts), float)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in range(len(keep))], pa.array(margin), pa.array(model.score(margin))],
                    names=[*keep, "margin", "score"],
                )

    return docs.select(*keep, "text").mapInArrow(
        run, schema.add("margin", "double").add("score", "double")
    )


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, margin, score`` for every row of ``docs`` (doc_id, text)."""
    marked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out")
    )
    of = labels.filter("toxic is not null").select(
        F.col("doc_id").alias("_labelled"), F.col("toxic").cast("int").alias("toxic")
    )
    model = learn(marked, of.filter(~held_out(F.col("_labelled"))).withColumnRenamed("_labelled", "doc_id"), settings)
    return scored(marked, model, ["doc_id", "held_out"])
