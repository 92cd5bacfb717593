"""Language identification by a linear-chain conditional random field over words.

A word's features are hashed: the word itself (the lexicon), its affixes of 1 to
4 bytes and its 2- to 4-grams with marked ends, of lower-cased UTF-8. Labels are
languages; transitions are learned together with the features by gradient of
the conditional likelihood (forward-backward). Training chains come from a
bounded sample of documents, and every second one is spliced from two documents
of different languages, so that staying and switching are both learned. A text's
words, in chains of at most ``CHAIN`` words, are labelled by forward-backward over
the chain and ``CONTEXT`` words on both sides of it, whose own posteriors are left out;
the language with the largest sum of posteriors is predicted, its share is the
score.

Defined results: null texts and texts without a letter are ``und`` with score 0;
words without a letter are left out; ties go to the first language by name;
repeated rows are scored one by one; extra columns are ignored; without any
language to learn every row is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scatterlake.llm import textops
from scatterlake.llm.pieces import _gather
from scatterlake.llm.tables import checkpoint, held_out, small, table

#: Documented bounds of the training sample: documents of a language, documents in all, chains of a document.
TRAIN_EACH, TRAIN_ROWS, TRAIN_CHAINS = 400, 4000, 8
BITS, CHAIN, CONTEXT, TRAIN_CHAIN, EPOCHS, BATCH, RATE, DECAY = 17, 64, 12, 32, 6, 1024, 0.05, 1e-6

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def words(buf: np.ndarray, offs: np.ndarray):
    """Starts and ends of the words with letters of lower-cased texts, and their offsets per text."""
    starts, ends, _ = textops.runs(textops.WORD_BYTE[buf], offs)
    letters = np.concatenate([[0], np.cumsum(_LETTER[buf], dtype=np.int64)])
    keep = letters[ends] > letters[starts]
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offs)


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, with offsets."""
    size = ends - starts
    marked = np.full(int((size + 2).sum()), 36, np.uint8)
    head = np.concatenate([[0], np.cumsum(size + 2)])
    marked[head[:-1]] = 94
    marked[_gather(head[:-1] + 1, size)] = buf[_gather(starts, size)]
    sums = textops.prefix_hash(marked)
    word = np.repeat(np.arange(len(size)), size + 2)
    found, owner = [], []

    def add(seed: int, a: np.ndarray, b: np.ndarray, of: np.ndarray) -> None:
        found.append((textops.keyed(textops.span_hash(sums, a, b), seed) >> np.uint64(64 - bits)).astype(np.int64))
        owner.append(of)

    every = np.arange(len(size))
    add(1, head[:-1], head[1:], every)
    for n in range(1, 5):
        long = size >= n
        add(10 + n, head[:-1][long] + 1, head[:-1][long] + 1 + n, every[long])
        add(20 + n, head[1:][long] - 1 - n, head[1:][long] - 1, every[long])
    for n in range(2, 5):
        at = np.arange(max(0, len(marked) - n + 1))
        inside = word[at] == word[at + n - 1]
        add(30 + n, at[inside], at[inside] + n, word[at[inside]])
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(owner_all[order], np.arange(len(size) + 1))


def emissions(weights: np.ndarray, found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each word's feature weights, one column a language."""
    sums = np.zeros((len(found) + 1, weights.shape[1]))
    np.cumsum(weights[found], axis=0, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def forward_backward(score: np.ndarray, length: np.ndarray, transition: np.ndarray):
    """Posteriors of chains score[c, t, label] of the given lengths, longest first; and scaled messages for training."""
    chains, steps, labels = score.shape
    e = np.exp(score - score.max(axis=2, keepdims=True))
    a = np.exp(transition)
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(steps)]  # chains longer than t
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    for t in range(steps):
        m = live[t]
        x = e[:m, t] if t == 0 else (alpha[:m, t - 1] @ a) * e[:m, t]
        alpha[:m, t] = x / x.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        m = live[t + 1]
        x = (e[:m, t + 1] * beta[:m, t + 1]) @ a.T
        beta[:m, t] = x / x.sum(axis=1, keepdims=True)
    post = alpha * beta
    total = post.sum(axis=2, keepdims=True)
    return post / np.where(total > 0, total, 1), alpha, beta, e, a, live


def chains(at: np.ndarray, most: int, context: int = 0) -> tuple[np.ndarray, ...]:
    """First word, length and text of every chain with its context, longest first, and where the chain itself begins and ends in it."""
    n = np.diff(at)
    per = -(-n // most)
    text = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = at[:-1][text] + k * most
    length = np.minimum(most, at[1:][text] - first)
    start = np.maximum(first - context, at[:-1][text])
    whole = np.minimum(first + length + context, at[1:][text]) - start
    order = np.argsort(-whole, kind="stable")
    return tuple(x[order] for x in (start, whole, text, first - start, first - start + length))


def posterior_sums(model: dict, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of word posteriors and number of words of each text (lower-cased)."""
    starts, ends, at = words(buf, offs)
    labels = model["weights"].shape[1]
    out = np.zeros((len(offs) - 1, labels))
    if not len(starts):
        return out, np.diff(at)
    _, which, back = np.unique(textops.span_hash(textops.prefix_hash(buf), starts, ends), return_index=True, return_inverse=True)
    score = emissions(model["weights"], *features(buf, starts[which], ends[which]))[back]
    first, length, text, begin, end = chains(at, CHAIN, CONTEXT)
    step = np.arange(int(length[0]))
    grid = np.where(step[None, :] < length[:, None], first[:, None] + step[None, :], 0)
    post = forward_backward(score[grid], length, model["transition"])[0]
    own = (step[None, :] >= begin[:, None]) & (step[None, :] < end[:, None])
    np.add.at(out, text, (post * own[:, :, None]).sum(axis=1))
    return out, np.diff(at)


def fit(texts: list[str], labels: list[str], seed: int = 11) -> dict:
    """Learns feature weights and transitions from whole documents' chains."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    size = len(names)
    model = {"names": names, "weights": np.zeros((1 << BITS, size), np.float32), "transition": np.zeros((size, size))}
    if size < 2:
        return model
    column = pc.utf8_lower(pa.array(texts, pa.string()))
    pieces = []
    for lo, hi, buf, offs in textops.slices(column, 1 << 40):
        starts, ends, at = words(buf, offs)
        _, which, back = np.unique(textops.span_hash(textops.prefix_hash(buf), starts, ends), return_index=True, return_inverse=True)
        found, cut = features(buf, starts[which], ends[which])
        for k in range(lo, hi):
            own = back[at[k] : at[k + 1]]
            parts = [own[i : i + TRAIN_CHAIN] for i in range(0, len(own), TRAIN_CHAIN)]
            chosen = sorted(rng.permutation(len(parts))[:TRAIN_CHAINS])
            pieces += [(parts[i], np.full(len(parts[i]), names.index(labels[k]))) for i in chosen]
    if not pieces:
        return model
    spliced = []
    for k, (w, y) in enumerate(pieces):
        other = pieces[int(rng.integers(len(pieces)))]
        if k % 2 and other[1][0] != y[0] and len(w) > 3:
            c = int(rng.integers(1, len(w)))
            w, y = np.concatenate([w[:c], other[0][: TRAIN_CHAIN - c]]), np.concatenate([y[:c], other[1][: TRAIN_CHAIN - c]])
        spliced.append((w, y))
    w, tr = model["weights"].astype(np.float64), model["transition"]
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    count, t = np.diff(cut), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(spliced))
        for lo in range(0, len(order), BATCH):
            batch = sorted((spliced[i] for i in order[lo : lo + BATCH]), key=lambda x: -len(x[0]))
            length = np.array([len(x[0]) for x in batch])
            ids, own = np.zeros((len(batch), length[0]), int), np.zeros((len(batch), length[0]), int)
            for i, (a, b) in enumerate(batch):
                ids[i, : len(a)], own[i, : len(b)] = a, b
            used, local = np.unique(ids, return_inverse=True)
            feats = found[_gather(cut[:-1][used], count[used])]
            ends_ = np.concatenate([[0], np.cumsum(count[used])])
            score = emissions(w, feats, ends_)[local.reshape(ids.shape)]
            post, alpha, beta, e, a, live = forward_backward(score, length, tr)
            inside = np.arange(length[0])[None, :] < length[:, None]
            delta = (np.eye(size)[own] - post) * inside[:, :, None]
            of_word = np.stack([np.bincount(local.ravel(), delta[:, :, k].ravel(), len(used)) for k in range(size)], axis=1)
            grad = np.stack([np.bincount(feats, np.repeat(of_word[:, k], count[used]), len(w)) for k in range(size)], axis=1)
            moved = np.zeros_like(tr)
            for s in range(1, length[0]):
                m = live[s]
                pair = alpha[:m, s - 1, :, None] * a[None] * (e[:m, s] * beta[:m, s])[:, None, :]
                moved -= (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                np.add.at(moved, (own[:m, s - 1], own[:m, s]), 1)
            t += 1
            for x, g, k in ((w, grad / len(batch) - DECAY * w, 0), (tr, moved / len(batch), 2)):
                moments[k] = 0.9 * moments[k] + 0.1 * g
                moments[k + 1] = 0.99 * moments[k + 1] + 0.01 * g * g
                x += RATE * (moments[k] / (1 - 0.9**t)) / (np.sqrt(moments[k + 1] / (1 - 0.99**t)) + 1e-8)
    return {"names": names, "weights": w.astype(np.float32), "transition": tr}


def train(documents: DataFrame, each: int = TRAIN_EACH) -> dict:
    """Fits on the documents of each language with the least hash of doc_id, held-out ones left out.

    Counts by language say which hashes can be among the least, so that the rank is taken
    over a few times ``each`` documents of a language and not over all of it. Of rows with
    one doc_id and language the least text is learned.
    """
    known = documents.select("doc_id", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = checkpoint(known.groupBy("lang").agg(F.count("*").alias("rows")))
    low = (F.xxhash64("doc_id") / 2.0**64 + 0.5) * F.col("rows") < 4 * each
    few = known.join(small(sizes), "lang").where(low).select("doc_id", "lang").distinct()
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).orderBy("place", "lang").limit(TRAIN_ROWS).select("doc_id", "lang")
    texts = documents.select("doc_id", "lang", "text").where("lang is not null and text is not null").join(F.broadcast(chosen), ["doc_id", "lang"])
    sample = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toPandas()
    sample = sample.sort_values(["doc_id", "lang"], kind="stable")
    return fit(sample["text"].tolist(), sample["lang"].tolist())


def predicted(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        names = pa.array([*model["names"], "und"], pa.string())
        for batch in batches:
            lang, score = np.full(batch.num_rows, len(model["names"])), np.zeros(batch.num_rows)
            letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in textops.slices(batch.column("text"), lower=True):
                if len(names) > 1:
                    sums, n = posterior_sums(model, buf, offs)
                    best = sums.argmax(axis=1)
                    real = letters[lo:hi] & (n > 0)
                    lang[lo:hi][real] = best[real]
                    score[lo:hi][real] = np.minimum(1.0, sums[np.arange(hi - lo), best] / np.maximum(n, 1))[real]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names.take(pa.array(lang)), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def label_words(model: dict, text: str) -> list[tuple[str, str]]:
    """Each word of a text with its most probable language."""
    low = pc.utf8_lower(pa.array([text], pa.string()))
    _, _, buf, offs = next(textops.slices(low))
    starts, ends, at = words(buf, offs)
    out: list[tuple[str, str]] = []
    score = emissions(model["weights"], *features(buf, starts, ends))
    for first, length, _, begin, end in sorted(zip(*chains(at, CHAIN, CONTEXT), strict=True)):
        post = forward_backward(score[None, first : first + length], np.array([length]), model["transition"])[0][0]
        own = slice(first + begin, first + end)
        out += [(bytes(buf[a:b]).decode(errors="replace"), model["names"][k]) for a, b, k in zip(starts[own], ends[own], post[begin:end].argmax(axis=1), strict=True)]
    return out


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return predicted(documents, train(documents)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
