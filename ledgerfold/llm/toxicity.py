"""Operator 7: toxicity by weak supervision.

1. *Voters.*  Every voter votes toxic, votes clean or abstains on a text: words of a
   seed lexicon of insults and words or word stems chosen by their evidence in
   labelled training rows (those of the toxic class vote toxic where they occur,
   those of the clean class clean; of nested strings only the one with most evidence
   is a voter), patterns (shouting, capitals, repeated marks), and silence, which
   votes clean where no other voter votes toxic.
2. *Label model.*  A generative model of the votes: a hidden class, and given the
   class a forest in which every vote depends on one other voter's vote at most; to
   abstain tells nothing.  Expectation maximisation estimates the votes'
   probabilities given the class (the voters' accuracies) and given the other vote
   (their correlations); the forest is the maximum spanning one by conditional
   mutual information, and leaves out what is not significant.  A copy of a voter is
   certain given the voter, so that copies of one piece of evidence count once.
   The model never sees the label of a row: labels choose voters, and their counts
   over all labelled rows give the class's share and prior rates of the votes.
3. *Classifier.*  A logistic regression on the presence of words, stems and
   patterns is trained on the posterior labels.  It alone scores texts.

Labels are learned only from rows whose ``crc32(doc_id as text) mod 5`` is not 0;
labels, language, source and identifier are no inputs of a score.

The labelled rows used are bounded by ``max_labelled`` (all rows below it, else a
hash sample of about that many); the features by ``max_features``.  Every text is
scored whole.

Defined results: a null text is empty; a text without features has the
intercept's score; a text is scored whole, however long; repeated rows score alike
(ties stay ties); a null label is no label; without
both classes among the labelled rows the seed lexicon alone scores; a null
``doc_id`` counts as the empty text for the fold; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm.common import cut, python_ready, table, text_of, worker_task

MAX_LABELLED = 12_000
MAX_FEATURES = 4_000
MAX_VOTERS = 300
MIN_SUPPORT = 4
#: Least likelihood-ratio statistic of a mined feature (chi-squared, one degree of
#: freedom; so high because tens of thousands of words are tried).
MIN_EVIDENCE = 24.0
#: Least share of the labelled rows with a feature that are toxic, for a voter.
RIGHT = 0.75
#: What a row with a voter counts in the choice of the next.
COVERED = 0.85
#: What prior rates from the labelled rows count, as a share of the rows.
KNOWN = 0.25
#: Votes, as columns of the model's tables.
ABSTAINS, TOXIC, CLEAN = 0, 1, 2
#: Least likelihood-ratio statistic of a dependence between two voters.
MIN_DEPENDENCE = 30.0
#: What a vote counts at the start where nothing is known of the voters.
START = 3.0
#: Rows that a dependence between two votes counts as if it were the same in both
#: classes.
SAME = 4.0
FOLDS = 5

#: Seed lexicon of common insults, by language.
SEED = {
    "en": "idiot moron stupid dumb loser scum trash garbage clown pathetic worthless disgusting ugly jerk fool imbecile filth vermin",
    "de": "idiot dumm trottel abschaum dreckig wertlos widerlich versager penner arschloch",
    "fr": "idiot imbécile crétin stupide ordure minable dégoûtant nul salaud connard",
    "es": "idiota estúpido imbécil basura escoria patético asqueroso inútil tonto cabrón",
}
#: Pattern voters.
PATTERNS = {
    "shout": r"!!",
    "capitals": r"\b[A-Z]{4,} [A-Z]{4,} [A-Z]{4,}",
    "address": r"(?i)\byou (?:are|re) ",
    "masked": r"[A-Za-z][*#@$]{2,}[A-Za-z]?",
    "questions": r"\?\?",
}
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STEMS = (4, 5)


def seed_words() -> list[str]:
    return sorted({w for line in SEED.values() for w in line.split()})


# --- features of a batch -------------------------------------------------------


@dataclass
class Words:
    """Distinct words of a batch with the documents they stand in."""

    words: pa.Array
    doc: np.ndarray
    code: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """Distinct (document, word) pairs."""
    normal = pc.replace_substring_regex(pc.utf8_lower(texts), BETWEEN, " ")
    lists = pc.ascii_split_whitespace(normal)
    flat = lists.flatten()
    sizes = np.diff(lists.offsets.to_numpy())
    coded = flat.dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), sizes)
    key = np.unique(doc * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False))
    n = max(1, len(coded.dictionary))
    return Words(coded.dictionary, key // n, key % n)


def kinds_of(words: pa.Array):
    """(prefix, strings) of each kind of feature, one string for each word; null
    where the word has none of this kind."""
    yield "w:", words
    length = pc.utf8_length(words)
    for n in STEMS:
        stem = pc.utf8_slice_codeunits(words, 0, n)
        yield f"s{n}:", pc.if_else(pc.greater_equal(length, n), stem, pa.scalar(None, pa.string()))


def pattern_hits(texts: pa.Array) -> dict[str, np.ndarray]:
    return {f"x:{k}": np.flatnonzero(pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False)) for k, p in PATTERNS.items()}


def hits(texts: pa.Array, features: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature number) pairs.  ``features``: for each kind its
    strings; numbers run through the kinds in order."""
    docs, numbers, base = [], [], 0
    found = words_of(texts)
    own = dict(kinds_of(found.words))
    marks = pattern_hits(texts)
    for kind, known in features.items():
        if kind == "x:":
            for i, name in enumerate(known.to_pylist()):
                d = marks.get(f"x:{name}", np.zeros(0, np.int64))
                docs.append(d)
                numbers.append(np.full(len(d), base + i))
        elif len(known):
            at = pc.fill_null(pc.index_in(own[kind], value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            f = at[found.code] if len(at) else np.zeros(0, np.int64)
            keep = f >= 0
            docs.append(found.doc[keep])
            numbers.append(f[keep] + base)
        base += len(known)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = np.unique(np.concatenate(docs).astype(np.int64) * max(1, base) + np.concatenate(numbers).astype(np.int64))
    return pair // max(1, base), pair % max(1, base)


# --- the label model -----------------------------------------------------------


@dataclass
class LabelModel:
    """Two classes (0 clean, 1 toxic) with a share of ``prior``; given the class, the
    vote of voter j depends on that of ``parent[j]`` (-1: on none).

    ``table[j, class, parent's vote, vote]`` are probabilities; a voter without a
    parent has the same row for every vote of it."""

    prior: float
    parent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3, 3)))
    rate: np.ndarray = field(default_factory=lambda: np.zeros((0, 2, 3)))
    known: np.ndarray | None = None

    def fit(self, votes: np.ndarray, known: np.ndarray | None = None, rounds: int = 24) -> np.ndarray:
        """``votes``: rows by voters, of ABSTAINS, TOXIC and CLEAN.  ``known``: prior
        rates of the votes (voter, class, vote), if there are any; they give the
        start, and count as much as ``KNOWN`` of all rows in the estimates.  Returns
        the posterior of the toxic class."""
        votes = votes.astype(np.int64)
        if known is None:
            first, self.known = np.tile([0.0, START, -START], (votes.shape[1], 1)), None
        else:
            first, self.known = np.log(known[:, 1] / known[:, 0]), known * KNOWN * len(votes)
            first[:, ABSTAINS] = 0
            self.known[:, 0] *= 1 - self.prior
            self.known[:, 1] *= self.prior
        lead = first[np.arange(votes.shape[1]), votes].sum(axis=1)
        q = 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + lead, -6, 6)))
        one_hot = np.zeros((len(votes), votes.shape[1] * 3), np.float32)
        one_hot[np.arange(len(votes))[:, None], np.arange(votes.shape[1]) * 3 + votes] = 1
        self.parent = np.full(votes.shape[1], -1)
        for step in range(rounds):
            weights = np.stack([1 - q, q])
            if step % 8 == 3:
                self.parent = self._forest(one_hot, weights)
            self._estimate(votes, weights)
            q = self.posterior(votes)
        return q

    def _estimate(self, votes: np.ndarray, weights: np.ndarray) -> None:
        n = votes.shape[1]
        self.rate, self.table = np.zeros((n, 2, 3)), np.zeros((n, 2, 3, 3))
        for j in range(n):
            above = votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(votes), np.int64)
            both = np.stack([np.bincount(above * 3 + votes[:, j], weights=weights[c], minlength=9).reshape(3, 3) for c in (0, 1)])
            alone = both.sum(axis=1) + (0 if self.known is None else self.known[j])
            self.rate[j] = (alone + (0.9, 0.05, 0.05)) / (alone.sum(axis=1, keepdims=True) + 1)
            if self.parent[j] < 0:
                self.table[j] = self.rate[j][:, None, :]
            else:
                pooled = both.sum(axis=0) + 1e-3
                pooled /= pooled.sum(axis=1, keepdims=True)
                self.table[j] = (both + SAME * pooled) / (both.sum(axis=2, keepdims=True) + SAME)
                # Where the other abstains, the vote stands alone.
                self.table[j, :, ABSTAINS] = self.rate[j]

    def _forest(self, one_hot: np.ndarray, weights: np.ndarray) -> np.ndarray:
        n = one_hot.shape[1] // 3
        gain = np.zeros((n, n))
        for w in weights:
            both = ((one_hot * w[:, None].astype(np.float32)).T @ one_hot).astype(float)
            alone = np.diag(both)
            with np.errstate(divide="ignore", invalid="ignore"):
                part = np.where(both > 0, both * np.log(both * max(w.sum(), 1e-9) / np.outer(alone, alone)), 0.0)
            gain += 2 * part.reshape(n, 3, n, 3).sum(axis=(1, 3))
        # The strongest dependences that close no cycle, each tree hung up by its first voter.
        rows, columns = np.triu_indices(n - 1, 1)  # the last voter, silence, follows from the others
        strong = gain[rows, columns] > MIN_DEPENDENCE
        rows, columns = rows[strong], columns[strong]
        root, near = list(range(n)), [[] for _ in range(n)]

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in np.argsort(-gain[rows, columns], kind="stable"):
            a, b = int(rows[i]), int(columns[i])
            if find(a) != find(b):
                root[find(a)] = find(b)
                near[a].append(b)
                near[b].append(a)
        parent, seen = np.full(n, -1), set()
        for first in range(n):
            work = [first] if first not in seen else []
            seen.add(first)
            while work:
                x = work.pop()
                for y in near[x]:
                    if y not in seen:
                        seen.add(y)
                        parent[y] = x
                        work.append(y)
        return parent

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        votes = votes.astype(np.int64)
        above = np.where(self.parent >= 0, votes[:, self.parent], 0)
        log = np.log(np.clip(self.table, 1e-9, 1))
        each = np.arange(votes.shape[1])
        ratio = np.where(votes == ABSTAINS, 0.0, log[each, 1, above, votes] - log[each, 0, above, votes])
        z = np.log(self.prior / (1 - self.prior)) + ratio.sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def accuracy(self) -> np.ndarray:
        """How probably each voter is right where it votes."""
        right = self.prior * self.rate[:, 1, TOXIC] + (1 - self.prior) * self.rate[:, 0, CLEAN]
        votes = self.prior * self.rate[:, 1, 1:].sum(axis=1) + (1 - self.prior) * self.rate[:, 0, 1:].sum(axis=1)
        return right / np.maximum(votes, 1e-12)


def likelihood_ratio(pos, neg, share: float):
    """The statistic of counts in the two classes against the toxic class's share,
    negative where the clean class has more."""
    n = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sum(np.where(x > 0, x * np.log(x / (n * p)), 0.0) for x, p in ((pos, share), (neg, 1 - share)))
    return 2 * gain * np.where(pos > n * share, 1, -1)


def choose_voters(flat: list[str], doc: np.ndarray, feature: np.ndarray, y: np.ndarray, most: int) -> list[tuple[str, int]]:
    """(feature, its vote) of the lexicon voters, the seeds first.

    One after the other the feature with most evidence for the toxic class is taken,
    if it is right on the share ``RIGHT`` of its labelled rows; a toxic row counts
    ``COVERED`` as much for each voter that it has already, so that rows get several
    voters but the twentieth word of the same rows is none.  Then those with most evidence for the clean
    class.  None is a stem of another voter."""
    seeds = {f"w:{w}" for w in seed_words()}
    chosen = [(name, TOXIC) for name in flat if name in seeds]
    taken = {name.partition(":")[2] for name in seeds}
    heads = {w[:n] for w in taken for n in STEMS}
    texts = [name.partition(":")[2] for name in flat]
    free = np.array([not name.startswith("x:") for name in flat])
    share, weight = y.mean(), np.ones(len(y))
    held = np.argsort(feature, kind="stable")
    starts = np.searchsorted(feature[held], np.arange(len(flat) + 1))
    rows_of = lambda i: doc[held[starts[i] : starts[i + 1]]]

    def close(i: int) -> None:
        """Nothing nested with a voter's text is free any more."""
        taken.add(texts[i])
        heads.update(texts[i][:n] for n in STEMS)
        for j in np.flatnonzero(free):
            t = texts[j]
            free[j] = not (t in taken or t in heads or any(t[:n] in taken for n in STEMS))

    for i, name in enumerate(flat):
        if name in seeds:
            close(i)
            weight[rows_of(i)] *= COVERED
    toxic = y[doc] == 1
    neg = np.bincount(feature[~toxic], minlength=len(flat)).astype(float)
    all_pos = np.bincount(feature[toxic], minlength=len(flat)).astype(float)
    while len(chosen) < most:
        pos = np.bincount(feature[toxic], weights=weight[doc[toxic]], minlength=len(flat))
        evidence = np.where(free & (all_pos >= RIGHT * (all_pos + neg)), likelihood_ratio(pos, neg, share), 0.0)
        i = int(np.argmax(evidence))
        if evidence[i] < MIN_EVIDENCE:
            break
        chosen.append((flat[i], TOXIC))
        close(i)
        weight[rows_of(i)] *= COVERED
    against = np.where(free, likelihood_ratio(all_pos, neg, share), 0.0)
    for i in np.argsort(against, kind="stable")[: max(0, most - len(chosen))]:
        if against[i] > -MIN_EVIDENCE:
            break
        if free[i]:
            chosen.append((flat[i], CLEAN))
            close(i)
    return chosen


def fit_logistic(doc: np.ndarray, feature: np.ndarray, target: np.ndarray, size: int,
                 l2: float = 1e-4, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Full-batch Adam on sparse binary features; deterministic."""
    w, b, n = np.zeros(size), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))), len(target)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(doc, weights=w[feature], minlength=n)
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / n
        g = np.append(np.bincount(feature, weights=d[doc], minlength=size) + l2 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


@dataclass
class Model:
    features: dict[str, list[str]]
    weights: np.ndarray
    intercept: float
    #: Name, estimated accuracy, and the voter that it depends on.
    voters: list[tuple[str, float, str | None]] = field(default_factory=list)

    def arrays(self) -> dict[str, pa.Array]:
        return {k: pa.array(v, pa.string()) for k, v in self.features.items()}

    def score(self, texts: pa.Array) -> np.ndarray:
        d, f = hits(texts, self.arrays())
        z = self.intercept + np.bincount(d, weights=self.weights[f], minlength=len(texts)) if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def seed_model() -> Model:
    words = seed_words()
    return Model({"w:": words, "x:": list(PATTERNS)}, np.array([4.0] * len(words) + [0.0] * len(PATTERNS)), -2.5)


# --- fitting in Spark ----------------------------------------------------------


def in_fold(column: str) -> F.Column:
    """Whether a row is held out of all learning."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % FOLDS == 0


def labelled_rows(docs: DataFrame, labels: DataFrame, id_column: str, label_column: str, text_column: str, most: int) -> DataFrame:
    """``text, y`` of at most about ``most`` labelled rows outside the held-out fold."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~in_fold("id"))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    total = known.count()
    if total > most:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(most / total * (1 << 20)))
    # At most about ``most`` rows of two numbers.
    own = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    return own.join(F.broadcast(known), "id").select("id", "text", "y")


def count_features(rows: DataFrame) -> DataFrame:
    """``feature, pos, neg``: labelled documents of each class that hold it."""

    schema = pa.schema([("feature", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

    def run(batches):
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            found = words_of(batch.column("text"))
            for kind, strings in kinds_of(found.words):
                coded = strings.dictionary_encode()
                code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                n = len(coded.dictionary)
                f = code[found.code] if len(code) else code
                keep = f >= 0
                pair = np.unique(found.doc[keep] * max(1, n) + f[keep])
                d, f = pair // max(1, n), pair % max(1, n)
                pos = np.bincount(f, weights=y[d], minlength=n).astype(np.int64)
                all_ = np.bincount(f, minlength=n).astype(np.int64)
                names = pc.binary_join_element_wise(kind, coded.dictionary, "")
                yield pa.RecordBatch.from_arrays([names, pa.array(pos), pa.array(all_ - pos)], schema=schema)

    return (
        rows.mapInArrow(worker_task(run), "feature string, pos bigint, neg bigint")
        .groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "toxic", text_column: str = "text",
        max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, max_voters: int = MAX_VOTERS) -> Model:
    spark = docs.sparkSession
    python_ready(spark)
    rows = cut(labelled_rows(docs, labels, id_column, label_column, text_column, max_labelled), "labelled")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return seed_model()
    # Evidence: the likelihood-ratio statistic of the feature's two counts, signed.
    share = n_pos / (n_pos + n_neg)
    n = F.col("pos") + F.col("neg")
    gain = sum(F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * p))).otherwise(0.0) for c, p in (("pos", share), ("neg", 1 - share)))
    counted = (
        count_features(rows)
        .where(n >= MIN_SUPPORT)
        .withColumn("evidence", 2 * gain * F.when(F.col("pos") > n * share, 1).otherwise(-1))
        .where(F.abs("evidence") >= MIN_EVIDENCE)
    )
    mined = counted.orderBy(F.abs("evidence").desc(), "feature").limit(max_features).collect()
    names = {k: [] for k in ("w:", *(f"s{n}:" for n in STEMS))}
    for r in mined:
        kind, _, word = r.feature.partition(":")
        names[f"{kind}:"].append(word)
    names["w:"] = sorted(set(names["w:"]) | set(seed_words()))
    names["x:"] = list(PATTERNS)
    model = Model(names, np.zeros(sum(map(len, names.values()))), 0.0)
    arrays = model.arrays()

    def sparse(batches):
        for batch in batches:
            d, f = hits(batch.column("text"), arrays)
            lists = np.split(f, np.cumsum(np.bincount(d, minlength=batch.num_rows))[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.string()), batch.column("y"), pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))], names=["id", "y", "f"])

    # At most about max_labelled rows, a few features each.
    got = rows.mapInArrow(worker_task(sparse), "id string, y int, f array<bigint>").orderBy("id", "y").toArrow()
    y = got.column("y").to_numpy().astype(float)
    lists = got.column("f").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    feature = lists.flatten().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(y)), pc.list_value_length(lists).to_numpy())

    flat = [f"{k}{w}" for k, words in names.items() for w in words]
    number = {name: i for i, name in enumerate(flat)}
    voters = choose_voters(flat, doc, feature, y, max_voters)
    voters += [(f"x:{p}", TOXIC) for p in PATTERNS]
    names_, votes = cast_votes(voters, number, doc, feature, len(y))
    label_model = LabelModel(float(np.clip(n_pos / (n_pos + n_neg), 0.01, 0.99)))
    posterior = label_model.fit(votes, known_rates(votes, y))
    model.weights, model.intercept = fit_logistic(doc, feature, posterior, len(flat))
    model.voters = [
        (name, float(right), names_[up] if up >= 0 else None)
        for name, right, up in zip(names_, label_model.accuracy(), label_model.parent, strict=True)]
    return model


def cast_votes(voters: list[tuple[str, int]], number: dict[str, int], doc: np.ndarray, feature: np.ndarray, rows: int) -> tuple[list[str], np.ndarray]:
    """Names of the voters that vote on MIN_SUPPORT rows at least, and rows by
    voters; the last one votes clean where none votes toxic."""
    place = np.full(len(number), -1)
    for i, (name, _) in enumerate(voters):
        place[number[name]] = i
    at = place[feature]
    votes = np.zeros((rows, len(voters) + 1), np.int64)
    kinds = np.array([vote for _, vote in voters])
    votes[doc[at >= 0], at[at >= 0]] = kinds[at[at >= 0]]
    keep = np.flatnonzero((votes > 0).sum(axis=0) >= MIN_SUPPORT)
    names, votes = [voters[i][0] for i in keep], np.concatenate([votes[:, keep], np.zeros((rows, 1), np.int64)], axis=1)
    votes[:, -1] = np.where((votes == TOXIC).any(axis=1), ABSTAINS, CLEAN)
    return [*names, "silence"], votes


def known_rates(votes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How often each voter votes how on the labelled rows of each class."""
    counts = np.stack([[(votes[y == c] == vote).sum(axis=0) for vote in (ABSTAINS, TOXIC, CLEAN)] for c in (0, 1)])
    counts = counts.transpose(2, 0, 1) + 0.5
    return counts / counts.sum(axis=2, keepdims=True)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and ``score`` of every row."""
    spark = docs.sparkSession
    python_ready(spark)
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1)), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    return rows.mapInArrow(worker_task(run), f"id {id_type}, score double").withColumnRenamed("id", id_column)


def keep_clean(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, whole."""
    python_ready(docs.sparkSession)
    at = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            yield batch.filter(pa.array(model.score(texts) < threshold))

    return docs.mapInArrow(worker_task(run), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", in_fold("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE: dict[str, str] = {}
