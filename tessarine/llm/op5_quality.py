"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text; the
human labels, where a table of them is given, are one labeller more that mostly
abstains.  Expectation-maximisation estimates how often each labeller casts
each vote, or none, on good and on bad texts and how common good ones are.  It needs only
how many documents cast each pattern of votes: a count over *all* documents
with at most 3**labellers rows, whatever the input's size.

The posteriors of the patterns then label a bounded sample (the ``SAMPLE``
rows with the smallest hashes of id and text, of those with at most MAX_SLOTS
features; documented parameters), which trains a logistic scorer over hashed
words, word stems, stems that several words of a text share, binned text
statistics and heuristic votes.  The scorer judges every document; labels play
no part in that.  There are two such heads: quality and toxicity; the second
uses only features that part its classes by SCREEN standard errors, as toxic
texts are rare.  A document is kept if its quality score is at least 1/2 and
its toxicity score under 1/2.

Nulls: a null text is empty; every labeller abstains on texts without words,
and such texts are not kept.  Rows with a null id have no human label and are
otherwise like others.  Rows that share an id share its human label.  Repeated
rows count in EM each time, once in the sample, and are scored alike.  Ties: a
label average or posterior of exactly 1/2 is no vote, or good.  Texts of any
length are scored whole.  Other columns pass through unless they begin with
``__tsr_``, which this operator replaces.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, mix64, pack, ship, table, text_buffers, text_slices, unpack
from .shingles import word_bounds, word_hashes

SAMPLE = 8000
#: errors on the rarer class (junk, toxic) weigh so much more
RARE = 3.0
DIM = 1 << 17
#: the first slots are for binned text statistics
SHAPE = 1 << 10
SLICE = 1 << 20
#: insults of general English; a parameter
TOXIC_WORDS = ("idiot", "idiots", "stupid", "moron", "morons", "loser", "losers", "pathetic", "scum", "trash", "worthless", "disgusting", "clown", "dumb", "filthy", "vermin", "imbecile", "jerk", "bastard", "shit", "fuck", "bitch", "whore", "retard", "subhuman")
STOP_WORDS = tuple("the of and to in is that for it was on are as with be this by he a an le la les de des et un une est que qui dans pour sur der die das und ist nicht den von mit zu ein eine el los las y en por con una del se".split())

NAMES = ("repeats", "variety", "capitals", "symbols", "bangs", "bars", "word_length", "stop_words", "digits", "plain", "human")
TOXIC_NAMES = ("lexicon", "disguised", "dense", "clean", "human")
#: weight in the toxicity head of texts that no person has judged
UNSEEN = 0.3
#: a toxicity feature must part the classes by so many standard errors
SCREEN = 4.0
#: longer texts than so many different features don't train (they are scored)
MAX_SLOTS = 1 << 13
#: beginnings of words, in bytes, that count when several words of a text share them
STEMS = (6, 7)
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[ord(c) for c in "0134578@$!"]] = [ord(c) for c in "oieastbasi"]
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*@^~<>=+\\{}[]|_"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _hash_words(words) -> np.ndarray:
    body = " ".join(words).encode()
    data = np.frombuffer(body, np.uint8)
    s, e, _ = word_bounds(data, np.array([0, len(data)]))
    return np.unique(word_hashes(data, s, e))


def statistics(data: np.ndarray, off: np.ndarray):
    """Per text: words, then shares (columns in the order of NAMES), lexicon hits; and the words' parts."""
    n = len(off) - 1
    s, e, doc = word_bounds(data, off)
    h = word_hashes(data, s, e)
    words = np.bincount(doc, minlength=n)
    many = np.maximum(words, 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    o = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[o][1:] != h[o][:-1]) | (doc[o][1:] != doc[o][:-1])
    different = np.bincount(doc[o][new], minlength=n)

    def per(mask):
        upto = np.r_[0, np.cumsum(mask)]
        return upto[off[1:]] - upto[off[:-1]]

    upper, lower = per(_UPPER[data]), per(_LOWER[data])
    chars = np.maximum(np.diff(off), 1)
    core = e - s
    # trailing punctuation doesn't make another word for the lexicons
    last = data[e - 1] if len(e) else data[:0]
    trim = e - ((core > 1) & np.isin(last, np.frombuffer(b".,;:!?", np.uint8)))
    bare = word_hashes(data, s, trim)
    bar = data == ord("|")
    twice = np.zeros(len(data), bool)
    twice[1:] = (data[1:] == ord("!")) & (data[:-1] == ord("!"))
    stats = np.stack(
        [
            np.bincount(doc[same], minlength=n) / many,
            different / np.maximum(many**0.75, 1),
            upper / np.maximum(upper + lower, 1),
            per(_SYMBOLS[data]) / chars,
            per(twice) / many,
            per(bar) / many,
            np.bincount(doc, weights=core, minlength=n) / many,
            np.bincount(doc[np.isin(bare, _STOP)], minlength=n) / many,
            per(_DIGIT[data]) / chars,
        ],
        axis=1,
    )
    # listed words as they stand, and with other marks around or figures for letters
    found = np.isin(bare, _TOXIC)
    letter = np.flatnonzero(_UPPER[data] | _LOWER[data])
    a, b = np.searchsorted(letter, s), np.searchsorted(letter, e)
    some = np.flatnonzero(b > a)
    core_hash = word_hashes(_PLAIN[data], letter[a[some]], letter[b[some] - 1] + 1)
    hidden = found.copy()
    hidden[some] |= np.isin(core_hash, _TOXIC)
    toxic = np.stack([np.bincount(doc[x], minlength=n) for x in (found, hidden)], axis=1)
    return words, stats, toxic, (s, trim, doc, bare)


_STOP, _TOXIC = _hash_words(STOP_WORDS), _hash_words(TOXIC_WORDS)
#: (bad from, unsuspicious to) of each share; a negative sign turns the order round
_RULES = ((0.15, 0.05), (-0.9, -1.6), (0.5, 0.2), (0.04, 0.01), (0.2, 0.02), (0.15, 0.02), (14.0, 9.0), (-0.02, -0.1), (0.15, 0.03))


def votes(words: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """(texts, labellers) of 0 (bad), 1 (good), 2 (no vote).

    Each kind of junk shows in few of the shares, so a share votes bad or not
    at all; only the stop words and the last labeller, for which nothing is
    suspicious, vote good.
    """
    out = np.full((len(words), len(_RULES) + 1), 2, np.uint8)
    plain = np.ones(len(words), bool)
    for i, (bad, good) in enumerate(_RULES):
        x = stats[:, i] if bad >= 0 else -stats[:, i]
        if NAMES[i] == "variety":
            x = np.where(words < 8, -9.0, x)
        out[x >= bad, i] = 0
        plain &= x <= good
        if NAMES[i] == "stop_words":
            out[x <= good, i] = 1
    out[plain, -1] = 1
    out[words == 0] = 2
    return out


def toxic_votes(words: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """(texts, labellers but people) of 0 (clean), 1 (toxic), 2 (no vote)."""
    plain, hidden = toxic[:, 0], toxic[:, 1]
    return np.stack([np.where(plain > 0, 1, 2), np.where(hidden > 0, 1, 2), np.where(hidden > 1, 1, 2), np.where((hidden == 0) & (words > 0), 0, 2)], axis=1).astype(np.uint8)


def _shared_stems(data: np.ndarray, s: np.ndarray, e: np.ndarray, doc: np.ndarray):
    """(document, hash) of beginnings that two, and that three, words of a text have."""
    for k in STEMS:
        long = np.flatnonzero(e - s > k)
        h, d = word_hashes(data, s[long], s[long] + k), doc[long]
        o = np.argsort(h)
        o = o[np.argsort(d[o], kind="stable")]
        h, d = h[o], d[o]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(first)
        times = np.diff(np.r_[at, len(h)])
        for level in (2, 3):
            pick = at[times >= level]
            yield d[pick], mix64(h[pick] + np.uint64(10 * k + level))


def _features(data: np.ndarray, off: np.ndarray):
    """Sparse rows (document, slot) of hashed features, each once a document."""
    n = len(off) - 1
    words, stats, toxic, (s, e, doc, bare) = statistics(data, off)
    stem = word_hashes(data, s, np.minimum(e, s + 4))
    bins = np.floor(np.sqrt(np.clip(stats, 0, 16)) * 20).astype(np.uint64)
    col = np.arange(stats.shape[1], dtype=np.uint64)
    cast = votes(words, stats).astype(np.uint64)
    said = mix64(cast * np.uint64(64) + np.arange(cast.shape[1], dtype=np.uint64) + np.uint64(1 << 20))
    shape = np.concatenate([mix64(mix64(bins * np.uint64(64) + col) + np.uint64(77)), said], axis=1)
    hits = toxic_votes(words, toxic)[:, :3] == 1
    hit_doc, hit = np.nonzero(hits)
    parts = [(doc, mix64(bare + np.uint64(1))), (doc[e - s >= 4], mix64(stem[e - s >= 4] + np.uint64(2))), *_shared_stems(data, s, e, doc), (hit_doc, mix64(hit.astype(np.uint64) + np.uint64(1 << 40)))]
    who = np.concatenate([*(x for x, _ in parts), np.repeat(np.arange(n), shape.shape[1])])
    shape = shape.ravel()
    what = np.concatenate([y for _, y in parts])
    slot = np.concatenate([SHAPE + what % np.uint64(DIM - SHAPE), shape % np.uint64(SHAPE)]).astype(np.int64)
    key = np.unique(who.astype(np.int64) * DIM + slot)
    return key // DIM, key % DIM, words, stats, toxic


def _text_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = text_buffers(b.column(1))
        q, t = [], []
        for i, j in text_slices(off, SLICE):
            words, stats, toxic, _ = statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])
            q += [bytes(r + 48).decode() for r in votes(words, stats)]
            t += [bytes(r + 48).decode() for r in toxic_votes(words, toxic)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(q, pa.string()), pa.array(t, pa.string())], names=["id", "row", "quality", "toxic"])


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = text_buffers(b.column(1))
        cells, size = [], []
        for i, j in text_slices(off, SLICE):
            d, slot, *_ = _features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            cut = np.searchsorted(d, np.arange(j - i + 1))
            cells += [pack(slot[x:y].astype(np.uint32)) for x, y in zip(cut[:-1], cut[1:])]
            size += np.diff(cut).tolist()
        got = pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(cells, pa.binary())], names=["row", "quality", "toxic", "cell"])
        yield got.filter(pa.array(np.array(size, np.int64) <= MAX_SLOTS))


def estimate(patterns: list[str], counts: np.ndarray, prior: float, trust: list[float], sure: bool = False, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: (posterior of class 1 by pattern, P(vote | class), P(class 1)).

    ``trust`` starts each labeller's accuracy, which also says which class is
    which.  Votes are '0', '1' or '2' (none).  With ``sure``, the last labeller
    (people) decides alone where it votes: labellers that copy one another can't
    outvote it, and are measured by it.
    """
    v = np.array([[int(c) for c in p] for p in patterns])
    n, m = v.shape
    one = np.eye(3)[v]
    p_vote = np.empty((m, 2, 3))
    for j, t in enumerate(trust):
        p_vote[j, 1], p_vote[j, 0] = [(1 - t) * 0.3, t * 0.3, 0.7], [t * 0.3, (1 - t) * 0.3, 0.7]
    share, post = prior, np.zeros(n)
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            log = np.log(p_vote)
        odds = np.log(share) - np.log(1 - share) + np.einsum("nmv,mv->n", one, log[:, 1] - log[:, 0])
        if sure:
            said = one[:, -1, 1] - one[:, -1, 0]
            odds = np.where(said != 0, said * np.log(trust[-1] / (1 - trust[-1])), odds)
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
        for c, w in ((1, counts * post), (0, counts * (1 - post))):
            p_vote[:, c] = np.einsum("n,nmv->mv", w, one) + 0.5
            p_vote[:, c] /= p_vote[:, c].sum(axis=1, keepdims=True)
        share = float(np.clip((counts @ post) / counts.sum(), 0.01, 0.99))
    return post, p_vote, share


def _values(rows: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
    """What each feature counts: statistics one, words less in longer texts."""
    size = np.maximum(np.bincount(rows, minlength=n), 1) ** -0.25
    return np.where(slots < SHAPE, 1.0, size[rows])


def screened(rows: np.ndarray, slots: np.ndarray, y: np.ndarray, weight: np.ndarray, least: float, z: float) -> np.ndarray:
    """Which features part the classes by z standard errors or more."""
    a, b = (np.bincount(slots, weights=(weight * c)[rows], minlength=DIM) for c in (y, 1 - y))
    n1, n0 = max((weight * y).sum(), 1e-9), max((weight * (1 - y)).sum(), 1e-9)
    p = (a + b + 1) / (n1 + n0 + 2)
    return (np.abs(a / n1 - b / n0) >= z * np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))) & (a + b >= least)


def fit(rows: np.ndarray, slots: np.ndarray, y: np.ndarray, weight: np.ndarray, rare: np.ndarray | float = 1.0, rounds: int = 100, decay: float = 2e-4, least: int = 4, screen: float = 0.0) -> tuple[np.ndarray, float, np.ndarray | None]:
    """Logistic regression by full-batch Adam: (weights, intercept, features that count or None for all).

    Features of under ``least`` texts have no weight; with ``screen``, nor have
    those that don't part the classes clearly, which keeps chance words out
    where one class is rare.
    """
    n = len(y)
    used = screened(rows, slots, y, weight, least - 1, screen) if screen else None
    weight = weight * rare
    if used is not None:
        rows, slots = rows[used[slots]], slots[used[slots]]
    x = _values(rows, slots, n)
    common = np.bincount(slots, minlength=DIM)[slots] >= (0 if screen else least)
    rows, slots, x = rows[common], slots[common], x[common]
    w, b = np.zeros(DIM), 0.0
    m, v, mb, vb = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    total = max(weight.sum(), 1e-9)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, weights=w[slots] * x, minlength=n) + b
        err = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / total
        g, gb = np.bincount(slots, weights=err[rows] * x, minlength=DIM) + decay * w, err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 * min(1.0, 2 * (1 - t / (rounds + 1)))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    return w.astype(np.float32), float(b), used


class Scorer:
    def __init__(self, heads: list[tuple[np.ndarray, float, np.ndarray | None]]):
        self.heads = heads

    def scores(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, (texts, heads) probabilities)."""
        n = len(off) - 1
        doc, slot, words, *_ = _features(data, off)
        z = []
        for w, b, used in self.heads:
            d, t = (doc, slot) if used is None else (doc[used[slot]], slot[used[slot]])
            z.append(np.bincount(d, weights=w[t] * _values(d, t, n), minlength=n) + b)
        return words, 1 / (1 + np.exp(-np.clip(np.stack(z, axis=1), -50, 50)))


def _score(model: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("__tsr_text")
            data, off = text_buffers(b.column(at))
            got = [model.scores(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in text_slices(off, SLICE)]
            words = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
            p = np.concatenate([g[1] for g in got]) if got else np.zeros((0, 2))
            keep = (words > 0) & (p[:, 0] >= 0.5) & (p[:, 1] < 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words.astype(np.int64)), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), pa.array(keep)], names=[*b.schema.names, "__tsr_words", "__tsr_quality", "__tsr_toxic", "__tsr_keep"])

    return lean(run)


def train(df: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, sample: int = SAMPLE) -> tuple[Scorer, dict]:
    """The scorer and what EM found about the labellers."""
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    # rows that share an id are told apart by their texts; equal rows are one in the sample
    base = df.select(ident.alias("id"), text.alias("text"), F.xxhash64(ident, text).alias("row"))
    cast = base.mapInArrow(lean(_text_votes), "id long, row long, quality string, toxic string")
    if labels is not None:
        said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
        cast = cast.join(said, "id", "left")
        human = [F.when(F.col(c).isNull() | (F.col(c) == 0.5), "2").when(F.col(c) > 0.5, "1").otherwise("0") for c in ("q", "t")]
    else:
        human = [F.lit("2"), F.lit("2")]
    cast = materialize(cast.select("row", F.concat("quality", human[0]).alias("quality"), F.concat("toxic", human[1]).alias("toxic")), "votes")
    got = cast.groupBy("quality", "toxic").agg(F.count("*").alias("n")).collect()
    report: dict = {}
    post: dict[str, dict[str, float]] = {}
    for head, names, prior, trust in (("quality", NAMES, 0.8, [0.8] * 10 + [0.95]), ("toxic", TOXIC_NAMES, 0.1, [0.8, 0.8, 0.8, 0.7, 0.99])):
        sums: dict[str, int] = {}
        for r in got:
            sums[r[head]] = sums.get(r[head], 0) + r["n"]
        pats = sorted(sums)
        if not pats:
            post[head] = {}
            continue
        p, p_vote, share = estimate(pats, np.array([sums[x] for x in pats], float), prior, trust, sure=head == "toxic")
        post[head] = dict(zip(pats, p.tolist()))
        said = p_vote[:, :, :2] / p_vote[:, :, :2].sum(axis=2, keepdims=True)  # of the votes that are cast
        report[head] = {"share": share, "accuracy": {n: (float(said[i, 0, 0]), float(said[i, 1, 1])) for i, n in enumerate(names)}}
    # the sample: smallest hashes of the row
    picked = cast.groupBy("row").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic")).orderBy(F.xxhash64("row", F.lit(5)), "row").limit(sample)
    found = base.join(F.broadcast(picked), "row").select("row", "text", "quality", "toxic").mapInArrow(lean(_sample_rows), "row long, quality string, toxic string, cell binary")
    rows = found.groupBy("row").agg(*[F.first(c).alias(c) for c in ("quality", "toxic", "cell")]).toArrow()
    slots = [unpack(c.as_buffer())[0].astype(np.int64) for c in rows.column("cell").combine_chunks()] if rows.num_rows else []
    order = sorted(range(len(slots)), key=lambda i: rows.column("row")[i].as_py())
    slots = [slots[i] for i in order]
    size = np.array([len(s) for s in slots], np.int64)
    doc, flat = np.repeat(np.arange(len(slots)), size), np.concatenate(slots) if slots else np.zeros(0, np.int64)
    heads = []
    for head in ("quality", "toxic"):
        y = np.array([post[head][rows.column(head)[i].as_py()] for i in order])
        # where nobody voted the posterior is the prior: it teaches nothing
        silent = np.array([set(rows.column(head)[i].as_py()) == {"2"} for i in order], bool)
        w = np.where(silent, 0.0, np.abs(2 * y - 1))
        if head == "toxic":  # lexicons know one language: without a person's word their votes count less
            human_said = np.array([rows.column(head)[i].as_py()[-1] != "2" for i in order], bool)
            w = np.where(human_said, w, UNSEEN * w)
        rare = np.where((y >= 0.5) == (head == "toxic"), RARE, 1.0)
        screen = SCREEN if head == "toxic" else 0.0
        heads.append(fit(doc, flat, (y >= 0.5).astype(float), w, rare, screen=screen) if len(y) else (np.zeros(DIM, np.float32), 3.0 if head == "quality" else -3.0, None))
    return Scorer(heads), report


def classify(df: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``df`` with __tsr_words, __tsr_quality, __tsr_toxic (probabilities) and __tsr_keep."""
    ship(df.sparkSession)
    model, _ = train(df, labels, id_col, text_col, sample)
    wide = df.withColumn("__tsr_text", F.col(f"`{text_col}`"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema) + ", __tsr_words long, __tsr_quality double, __tsr_toxic double, __tsr_keep boolean"
    return wide.mapInArrow(_score(model), schema).drop("__tsr_text")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = classify(docs, table(spark, sf_dir, "labels"))
    return done.select("doc_id", F.col("__tsr_words").alias("n_words"), F.col("__tsr_quality").alias("quality_score"), F.col("__tsr_toxic").alias("toxic_score"), F.col("__tsr_keep").alias("kept"))
