"""Language-model scoring: a causal self-attention model, trained in numpy on subword ids.

Texts are lower-cased (A-Z), their words joined by one blank and encoded by the public byte-level BPE vocabulary. Every id has an
input vector of its own. One masked self-attention layer reads the last ids; the state, plus a vector for the last two ids together
(hashed to PAIRS slots), gives the weights of PARTS output distributions over all ids. The probability of the next id is the mixture of
its PARTS probabilities, so no normalisation over the vocabulary is needed. An end symbol closes every text.

Learning: the texts are encoded once and stored. The model starts from WARM_DOCS training documents on the driver (a fixed number of steps);
then all training documents are dealt by a hash into groups of about GROUP ids, and each group trains a copy of all weights on every window
of its documents. Weights are averaged (vectors of ids and pairs by how often the group met them); the output distributions
are set from counts of (id, part) over the whole corpus, a part being drawn from each id's posterior. Averages and counts are
sums of whole numbers over groups that depend on the rows alone, so neither partitions nor task order change the model.

Scoring: windows of WINDOW ids overlap by WINDOW - STRIDE; each id is scored once, in the window that gives it the longest
context. Windows of many documents form one batch with a shared causal mask.

The unigram base needs the count of every word: the HEAD most frequent words are broadcast (a bounded table), all others are joined
in the shuffle.

Defined cases: null and empty texts are the end symbol alone; a null doc_id counts as the empty text for the split and for the
groups; without training rows all counts are 0; repeated rows are scored alike; an empty table gives no rows; very long texts are trained on and scored in batches of
windows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import arrow_batch, crc_mod, documents, rows_of, ship, staged

WIDTH, PARTS, LANE, PAIRS = 24, 96, 8, 1 << 16
WINDOW, STRIDE = 16, 14
WARM_DOCS, WARM_STEPS, REFIT, BATCH = 1000, 2500, 20, 128
#: Adam rates of the shared weights, and how much faster the vectors of ids and pairs (Adagrad) move.
WARM_RATE, RATE, ID_PACE, PAIR_PACE = 0.01, 0.006, 12, 60
#: Ids in a group, most groups (beyond it groups grow), ids trained on at a time, weight of the unigram in each output distribution.
GROUP, MOST_GROUPS, CHUNK, PRIOR = 1 << 23, 1 << 14, 1 << 18, 20
HEAD, FLUSH = 1 << 17, 1 << 18
#: Fixed-point unit of averaged weights.
UNIT = 1 << 16
_LN10 = float(np.log(10))
_one = np.float32


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased: bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode("utf-8", "replace").lower().split()


class Subwords:
    """Ids of a text's words joined by one blank, as 16-bit numbers; ``size`` is the end symbol."""

    def __init__(self, path: str | None = None):
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = max(ranks.values()) + 1

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.array(self.encode(b" ".join(words).decode()), dtype=np.uint16)


def pair_slots(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Slot of each pair of neighbouring ids."""
    with np.errstate(over="ignore"):
        h = before.astype(np.uint32) * np.uint32(0x9E3779B1) ^ ids.astype(np.uint32) * np.uint32(0x85EBCA77)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((h ^ (h >> np.uint32(13))) % np.uint32(PAIRS)).astype(np.int32)


def windows(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, pair slots, targets (-1 where a position is padding or was scored in the window before) and owner of each window.

    A sequence is the end symbol, the ids of a text, the end symbol.
    """
    n = np.fromiter((len(s) - 1 for s in sequences), dtype=np.int64, count=len(sequences))  # predictions
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    base = np.cumsum(np.append(0, n[:-1] + 1))
    owner = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    last = (n[owner] - 1)[:, None]
    at = (nth * STRIDE)[:, None] + np.arange(WINDOW)
    flat = np.concatenate(sequences).astype(np.int32)
    before = np.roll(flat, 1)
    before[base] = flat[base]
    spot = np.minimum(at, last) + base[owner][:, None]
    target = flat[spot + 1]
    target[at > last] = -1
    target[nth > 0, : WINDOW - STRIDE] = -1
    return flat[spot], pair_slots(before, flat)[spot], target, owner


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts 16-bit keys, the first place of each run of equal keys, and the key of each run."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    ordered = np.take(keys, order)
    new = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return order, first, ordered[first]


def _sums(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows by runs of ``order``; where most runs are one row, which is its own sum, only the longer ones are added up."""
    if 2 * len(first) < len(order):
        return np.add.reduceat(np.take(values, order, axis=0), first, axis=0)
    out = np.take(values, order[first], axis=0)
    length = np.diff(first, append=len(order))
    long = np.flatnonzero(length > 1)
    if len(long):
        size = length[long]
        out[long] = np.add.reduceat(np.take(values, order[np.repeat(length > 1, length)], axis=0), np.cumsum(size) - size, axis=0)
    return out


class Attention:
    """Weights and passes of the model; arrays are float32.

    w: shared weights; E: vectors of ids, then of pairs; O: probability of each id in each part.
    """

    SHAPES = {"P": (WINDOW, WIDTH), "Q": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "U": (WIDTH, PARTS), "u": (PARTS,)}

    def __init__(self, size: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.size = size  # with the end symbol
        self.w = {k: (rng.normal(0, 0.1 if k == "P" else s[0] ** -0.5, s) if len(s) > 1 else np.zeros(s)).astype(_one) for k, s in self.SHAPES.items()}
        self.E = rng.normal(0, 0.3, (size + PAIRS, WIDTH)).astype(_one)
        self.E[size:] *= _one(0.3)
        self.seen = np.zeros_like(self.E)
        self.O = np.full((size, PARTS), 1 / size, dtype=_one)
        self.start()

    def start(self) -> None:
        self.mask = np.tril(np.ones((WINDOW, WINDOW), dtype=_one))
        ends = np.cumsum([0, *[v.size for v in self.w.values()]])
        self.spans = {k: slice(a, b) for k, a, b in zip(self.w, ends, ends[1:], strict=False)}
        self.flat = np.zeros((2, ends[-1]), dtype=self.w["P"].dtype)
        self.moments = {k: tuple(x[self.spans[k]].reshape(v.shape) for x in self.flat) for k, v in self.w.items()}  # views of flat
        self.steps = 0

    def packed(self, used: np.ndarray) -> dict:
        """What a task needs to rebuild the model: vectors that differ from the first ones, in half precision, and the output rows of the ids ``used``; all others are alike."""
        at = np.flatnonzero((self.E != Attention(self.size).E).any(axis=1))
        rest = np.setdiff1d(np.arange(self.size), used)[:1]
        return {"size": self.size, "w": self.w, "at": at, "E": self.E[at].astype(np.float16), "seen": self.seen[at].mean(axis=1), "used": used, "O": self.O[used], "rest": self.O[rest]}

    @staticmethod
    def unpacked(parts: dict) -> Attention:
        model = Attention(parts["size"])
        model.w, model.E[parts["at"]], model.seen[parts["at"]] = {k: v.copy() for k, v in parts["w"].items()}, parts["E"], parts["seen"][:, None]
        if len(parts["rest"]):
            model.O[:] = parts["rest"]
        model.O[parts["used"]] = parts["O"]
        model.start()
        return model

    def attend(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Inputs, queries, attention, mean of the inputs under it, and state, for windows of ids."""
        x = np.take(self.E, ids, axis=0)
        x += self.w["P"]
        flat = x.reshape(-1, WIDTH)
        q = (flat @ self.w["Q"]).reshape(x.shape)
        a = np.matmul(q, x.transpose(0, 2, 1))
        np.exp(np.minimum(a, 30, out=a), out=a)
        a *= self.mask
        a /= (a.reshape(-1, WINDOW) @ np.ones(WINDOW, dtype=a.dtype)).reshape(*ids.shape, 1)
        c = np.matmul(a, x)
        return x, q, a, c, c.reshape(-1, WIDTH) @ self.w["V"] + flat

    def told(self, state: np.ndarray, real: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Rows of states with the vectors of their pairs, and a one for u."""
        h = np.ones((len(real), WIDTH + 1), dtype=state.dtype)
        np.add(np.take(state, real, axis=0), np.take(self.E, pair + self.size, axis=0), out=h[:, :WIDTH])
        return h

    def parts(self, h: np.ndarray) -> np.ndarray:
        """Unnormalised weights of the parts."""
        e = h @ np.concatenate((self.w["U"], self.w["u"][None]))
        np.clip(e, -60, 60, out=e)
        return np.exp(e, out=e)

    def logp(self, ids: np.ndarray, pairs: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log-probability of the targets that are not negative, row by row."""
        real = np.flatnonzero(target >= 0)
        e = self.parts(self.told(self.attend(ids)[-1], real, pairs.reshape(-1)[real]))
        ones = np.ones(PARTS, dtype=e.dtype)
        total = e @ ones
        e *= np.take(self.O, target.reshape(-1)[real], axis=0)
        return np.log(e @ ones / total)

    def step(self, ids: np.ndarray, pairs: np.ndarray, target: np.ndarray, rate: float, gather=None) -> None:
        """One step on windows; targets below 0 are left out. ``gather`` gets targets and their posteriors."""
        w = self.w
        x, q, a, c, h = self.attend(ids)
        real = np.flatnonzero(target >= 0)
        y, pair, n = target.reshape(-1)[real], pairs.reshape(-1)[real], max(1, len(real))
        h = self.told(h, real, pair)
        e = self.parts(h)
        r = np.take(self.O, y, axis=0)
        r *= e
        ones = np.ones(PARTS, dtype=r.dtype)
        joint, total = r @ ones, e @ ones
        r *= (1 / joint)[:, None]
        if gather:
            gather(y, r)
        e *= (1 / total)[:, None]
        e -= r  # slope of the loss at the logits of the parts
        gu = h.T @ e / n
        g = {"U": gu[:WIDTH], "u": gu[WIDTH]}
        dh = e @ (w["U"].T / n)  # from here on slopes of the mean
        full = np.zeros((ids.size, WIDTH), dtype=x.dtype)
        full[real] = dh
        flat = lambda m: m.reshape(-1, m.shape[-1])
        g["V"] = flat(c).T @ full
        dc = (full @ w["V"].T).reshape(c.shape)
        ds = np.matmul(dc, x.transpose(0, 2, 1))
        ds -= (flat(dc * c) @ np.ones(WIDTH, dtype=c.dtype)).reshape(*ids.shape, 1)
        ds *= a
        dx = np.matmul(a.transpose(0, 2, 1), dc)
        dx += full.reshape(x.shape)
        dq = np.matmul(ds, x)
        g["Q"] = flat(x).T @ flat(dq)
        dx += (flat(dq) @ w["Q"].T).reshape(x.shape)
        dx += np.matmul(ds.transpose(0, 2, 1), q)
        g["P"] = dx.sum(axis=0)
        self._adagrad(ids.reshape(-1), 0, flat(dx), rate * ID_PACE)
        self._adagrad(pair, self.size, dh, rate * PAIR_PACE)
        self.steps += 1
        grad, (m, s) = np.concatenate([g[k].ravel() for k in w]), self.flat
        m += 0.1 * (grad - m)
        s += 0.01 * (grad * grad - s)
        move = rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-8)
        for name, span in self.spans.items():
            w[name] -= move[span].reshape(w[name].shape).astype(w[name].dtype)

    def _adagrad(self, keys: np.ndarray, base: int, slopes: np.ndarray, rate: float) -> None:
        if not len(keys):
            return
        order, first, key = _runs(keys)
        grad = _sums(slopes, order, first)
        key = key + base
        seen = np.take(self.seen, key, axis=0)
        seen += grad * grad
        self.seen[key] = seen
        np.sqrt(seen, out=seen)
        seen += 1e-8
        grad /= seen
        grad *= grad.dtype.type(rate)
        rows = np.take(self.E, key, axis=0)
        rows -= grad
        self.E[key] = rows


def outputs(counts: np.ndarray, unigram: np.ndarray) -> np.ndarray:
    """Probabilities of ids in each part from counts of (id, part), with PRIOR counts of the unigram."""
    out = counts + PRIOR * unigram[:, None]
    out /= counts.sum(axis=0) + PRIOR
    return out.astype(_one)


def unigram(by_id: np.ndarray) -> np.ndarray:
    return (by_id + 0.5) / (by_id.sum() + 0.5 * len(by_id))


def warmed(sequences: list[np.ndarray], prior: np.ndarray) -> Attention:
    """First weights: WARM_STEPS steps over the windows of ``sequences``, the output distributions refitted every REFIT steps."""
    model, rng = Attention(len(prior)), np.random.default_rng(5)
    counts = rng.normal(0, 1, model.O.shape)
    np.exp(counts, out=counts)
    counts *= prior[:, None]
    counts = counts.astype(_one)
    counts *= 2000 / counts.sum(axis=0)
    model.O = outputs(counts, prior)
    if not sequences:
        return model
    ids, pairs, target, _ = windows(sequences)
    order, fresh = rng.permutation(len(ids)), np.zeros_like(counts)

    def gather(y: np.ndarray, r: np.ndarray) -> None:
        at, first, key = _runs(y)
        fresh[key] += _sums(r, at, first)

    for i in range(WARM_STEPS):
        some = np.take(order, np.arange(i * BATCH, (i + 1) * BATCH), mode="wrap")
        model.step(ids[some], pairs[some], target[some], WARM_RATE * (1 - i / WARM_STEPS) + WARM_RATE / 20, gather)
        if i % REFIT == REFIT - 1:
            new = max(0.03, 1 / (2 + i / REFIT))
            counts *= 1 - new
            counts += fresh * (new * len(ids) / (REFIT * BATCH))
            fresh[:] = 0
            model.O = outputs(counts, prior)
    return model


class Drawn:
    """Counts of (id, part), the part of each id drawn from its posterior: whole numbers whose mean are the posterior's sums."""

    def __init__(self, size: int, seed: int):
        self.counts, self.rng = np.zeros(size * PARTS, dtype=np.int64), np.random.default_rng(seed)
        self.within = np.tril(np.ones((LANE, LANE), dtype=_one))
        self.lanes = np.tril(np.ones((PARTS // LANE,) * 2, dtype=_one))

    def __call__(self, y: np.ndarray, r: np.ndarray) -> None:
        """First a lane of LANE parts is drawn, then a part of it: running sums, as products with triangles of ones, are short instead of one long one."""
        places, lanes = np.arange(len(y)), len(self.lanes)
        upto = self.lanes @ (r.reshape(-1, LANE) @ np.ones(LANE, dtype=_one)).reshape(-1, lanes).T
        at = self.rng.random(len(y), dtype=_one) * upto[-1]
        lane = np.minimum((upto <= at).view(np.int8).sum(axis=0, dtype=np.int8), lanes - 1).astype(np.intp)
        at -= np.where(lane > 0, upto[lane - 1, places], 0)
        inside = self.within @ np.take(r.reshape(-1, LANE), places * lanes + lane, axis=0).T
        part = np.minimum((inside <= at).view(np.int8).sum(axis=0, dtype=np.int8), LANE - 1)
        np.add.at(self.counts, y * PARTS + lane * LANE + part, 1)


def _framed(ids: np.ndarray, end: int) -> np.ndarray:
    return np.concatenate(([end], ids, [end])).astype(np.int32)


def trained(mine: Attention, documents: Iterator[bytes], expected: int) -> tuple[Drawn, np.ndarray, int]:
    """Trains the model on all windows of ``documents`` (ids). Returns the drawn counts, how often each row of E was met, and the ids seen."""
    model, end = mine, mine.size - 1
    drawn, met, done, held, size = Drawn(model.size, 17), np.zeros(len(model.E), dtype=np.int64), 0, [], 0

    def train() -> None:
        nonlocal done
        ids, pairs, target, _ = windows(held)
        met[: model.size] += np.bincount(ids.reshape(-1), minlength=model.size)
        met[model.size :] += np.bincount(pairs[target >= 0], minlength=PAIRS)
        order = np.random.default_rng(23).permutation(len(ids))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            left = max(0.05, 1 - (done + size * a / len(order)) / max(1, expected))
            mine.step(ids[some], pairs[some], target[some], RATE * left, drawn)
        done += size

    for raw in documents:
        held.append(_framed(np.frombuffer(raw, dtype=np.uint16), end))
        size += len(held[-1]) - 1
        if size >= CHUNK:
            train()
            held, size = [], 0
    if held:
        train()
    return drawn, met, done


def log10_scores(model: Attention, sequences: list[np.ndarray], chunk: int = 128) -> np.ndarray:
    out = np.zeros(len(sequences))
    ids, pairs, target, owner = windows(sequences)
    for a in range(0, len(ids), chunk):
        t = target[a : a + chunk]
        out += np.bincount(np.repeat(owner[a : a + chunk], (t >= 0).sum(axis=1)), model.logp(ids[a : a + chunk], pairs[a : a + chunk], t), len(out))
    return out / _LN10


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input rows (doc_id, text, train) as kind s with their ids; counts of the training words (w), subword ids (i) and documents (d). Words are flushed when many."""
    sub = Subwords()
    words, by_id, docs, schema = Counter(), np.zeros(sub.size, dtype=np.int64), 0, None

    def counts(kind: str, keys: list[str], n: list[int]) -> pa.RecordBatch:
        empty = [None] * len(keys)
        return arrow_batch(schema, [[kind] * len(keys), keys, n, empty, empty, empty, empty])

    for batch in batches:
        schema = pa.schema([("kind", pa.string()), ("key", pa.string()), ("n", pa.int64()), ("doc_id", batch.schema.field("doc_id").type), ("train", pa.bool_()), ("text", pa.string()), ("ids", pa.binary())])
        for ids, train, texts in rows_of(iter([batch]), "doc_id", "train", "text", limit=1 << 20):
            coded = []
            for learn, text in zip(train, texts, strict=True):
                split = words_of(text)
                coded.append(sub.ids(split))
                if learn:
                    words.update(split)
                    docs += 1
            own = [c for c, learn in zip(coded, train, strict=True) if learn]
            if own:
                by_id += np.bincount(np.concatenate(own), minlength=sub.size)
            n = len(ids)
            yield arrow_batch(schema, [["s"] * n, [None] * n, [len(c) for c in coded], ids, train, texts, [c.tobytes() for c in coded]])
            if len(words) > FLUSH:
                yield counts("w", [w.decode() for w in words], list(words.values()))
                words.clear()
    if docs:
        some = np.flatnonzero(by_id)
        yield counts("w", [w.decode() for w in words], list(words.values()))
        yield counts("i", [str(i) for i in some], by_id[some].tolist())
        yield counts("d", [""], [docs])


def coded(docs: DataFrame) -> DataFrame:
    """Stored rows of ``_coded``. ``docs``: doc_id, text, train."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(_coded, f"kind string, key string, n bigint, doc_id {kind}, train boolean, text string, ids binary")
    return staged(rows, "lm-coded", compression="zstd")


def learn(rows: DataFrame, counts: DataFrame) -> Attention:
    """The model. ``rows``: doc_id and ids of the training documents; ``counts``: key and n of their subword ids."""
    ship(rows.sparkSession)
    spark, end = rows.sparkSession, Subwords().size
    by_id = np.zeros(end + 1)
    for r in counts.collect():  # bounded by the vocabulary
        by_id[int(r["key"])] = r["n"]
    by_id[end] = rows.count()
    prior, total = unigram(by_id), int(by_id.sum())
    first = rows.orderBy(F.xxhash64("ids"), "ids").limit(WARM_DOCS).collect()
    model = warmed([_framed(np.frombuffer(r["ids"], dtype=np.uint16), end) for r in first], prior)
    if not first:
        return model
    del first
    groups = min(MOST_GROUPS, max(1, -(-total // GROUP)))
    used = np.flatnonzero(by_id)
    start, expected = spark.sparkContext.broadcast(model.packed(used)), total // groups  # bounded by the vocabulary, PAIRS and PARTS
    columns = [f"v{i}" for i in range(WIDTH)]
    schema = pa.schema([("kind", pa.string()), ("at", pa.int64()), ("n", pa.int64()), *[(c, pa.int64()) for c in columns]])

    def tune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = (x.as_py() for batch in batches for x in batch.column(0))
        mine = Attention.unpacked(start.value)
        drawn, met, done = trained(mine, raw, expected)
        if not done:
            return

        def out(kind: str, at: np.ndarray, n: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(at), 1 << 14):
                part = slice(a, a + (1 << 14))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at[part])), pa.array(at[part]), pa.array(n[part]), *[pa.array(values[part, i]) for i in range(WIDTH)]], schema=schema)

        rows = np.flatnonzero(met)
        yield from out("e", rows, met[rows], np.rint(mine.E[rows].astype(np.float64) * met[rows, None] * UNIT).astype(np.int64))
        flat = np.concatenate([x.ravel() for x in mine.w.values()]).astype(np.float64)
        flat = np.rint(np.pad(flat, (0, -len(flat) % WIDTH)).reshape(-1, WIDTH) * done * UNIT).astype(np.int64)
        yield from out("w", np.arange(len(flat)), np.full(len(flat), done), flat)
        some = np.flatnonzero(drawn.counts)  # counts of (id, part), WIDTH to a row
        some = np.unique(some // WIDTH)
        padded = np.pad(drawn.counts, (0, -len(drawn.counts) % WIDTH)).reshape(-1, WIDTH)
        yield from out("o", some, np.zeros(len(some), dtype=np.int64), padded[some])

    dealt = rows.select("ids", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "ids").alias("dice"))
    dealt = dealt.repartitionById(groups, F.pmod("dice", F.lit(groups)).cast("int")).sortWithinPartitions("dice", "ids")
    sums = dealt.select("ids").mapInArrow(tune, ", ".join(f"{f.name} {'string' if f.name == 'kind' else 'bigint'}" for f in schema))
    sums = sums.groupBy("kind", "at").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).toArrow()  # bounded as the model is
    start.destroy()
    kind, at, n = (sums.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "at", "n"))
    rows_, parts, shared = kind == "e", kind == "o", kind == "w"
    drawn = np.zeros((-(-len(prior) * PARTS // WIDTH), WIDTH))
    flat = np.zeros((int(shared.sum()), WIDTH))
    for i, c in enumerate(columns):  # one column at a time: the driver holds the sums once
        values = sums.column(c).to_numpy().astype(np.float64)
        model.E[at[rows_], i] = values[rows_] / n[rows_] / UNIT
        drawn[at[parts], i] = values[parts]
        flat[at[shared], i] = values[shared] / n[shared] / UNIT
    del sums
    model.O = outputs(drawn.ravel()[: len(prior) * PARTS].reshape(-1, PARTS), prior)
    flat, ends = flat.ravel(), np.cumsum([0, *[x.size for x in model.w.values()]])
    model.w = {k: flat[a:b].reshape(x.shape).astype(_one) for (k, x), a, b in zip(model.w.items(), ends, ends[1:], strict=False)}
    return Attention.unpacked(model.packed(used))


def scored(docs: DataFrame) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text, train); learnt from those whose train is true."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    rows = coded(docs.select("doc_id", "text", "train"))
    counts = staged(rows.where("kind <> 's'").groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    sums = {r["kind"]: (r["n"], r["rows"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    n_docs = sums.get("d", (0, 0))[0]
    total, distinct = sums.get("w", (0, 0))[0] + n_docs, sums.get("w", (0, 0))[1] + (n_docs > 0)
    rows = rows.where("kind = 's'")
    model = learn(rows.where("train").select("doc_id", "ids"), counts.where("kind = 'i'").select("key", "n"))
    words = counts.where("kind = 'w'").select(F.col("key").alias("word"), F.col("n").alias("c"))
    head_rows = words.orderBy(F.desc("c"), "word").limit(HEAD)
    head = {r["word"].encode(): float(np.log10(r["c"] + 0.1)) for r in head_rows.collect()}
    used = np.array(sorted(int(r["key"]) for r in counts.where("kind = 'i'").collect()) + [model.size - 1])  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast((model.packed(used), head))  # bounded: HEAD words and the model
    per_token = float(np.log10(total + 0.1 * (distinct + 1)))
    end = float(np.log10(n_docs + 0.1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, head = shared.value
        model, get = Attention.unpacked(parts), head.get
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("head", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(pa.string()))])
            for ids, train, raw, texts in rows_of(iter([batch]), "doc_id", "train", "ids", "text", limit=1 << 20):
                n, known, base, tails = [], [], [], []
                for text in texts:
                    own = words_of(text)
                    values = list(map(get, own))
                    tail = [w.decode() for w, x in zip(own, values, strict=True) if x is None] if None in values else []
                    n.append(len(own) + 1)
                    known.append(len(own) - len(tail) + (n_docs > 0))
                    base.append(sum(x for x in values if x is not None) + end if tail else sum(values) + end)
                    tails.append(tail)
                sequences = [_framed(np.frombuffer(x, dtype=np.uint16), model.size - 1) for x in raw]
                yield arrow_batch(schema, [ids, train, n, known, base, log10_scores(model, sequences).tolist(), tails])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", "train", "text", "ids").mapInArrow(run, f"doc_id {kind}, train boolean, n_tokens bigint, known bigint, head double, score double, tail array<string>")
    found = staged(found.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = found.select("row", F.explode("tail").alias("word")).join(words, "word", "left")
    tails = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("tail_score"), F.count("c").alias("tail_known"))
    zero = F.lit(0)
    return found.drop("tail").join(tails, "row", "left").select(
        "doc_id", "train", "n_tokens", (F.col("known") + F.coalesce("tail_known", zero)).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("head") + F.coalesce("tail_score", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"), "score",
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = scored(docs.select("doc_id", "text", (crc_mod("doc_id", 10) != 0).alias("train")))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), *out.columns[2:])
