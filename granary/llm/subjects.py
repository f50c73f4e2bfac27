"""Problem 10: the subject areas of each document.

Method: the document-term matrix is factored with non-negative alternating (multiplicative, Kullback-Leibler) updates.
Each area has one component, seeded with the terms of its description and of the documents labelled with it; labelled
documents may use only their areas' components, which anchors them; further components take what all texts share.
Every update runs over all documents. The term factors are then anchored: a term keeps the areas that have more than
two fifths of its use, the rest of it goes to a background component. Multiplicative updates of the row factors of each
sentence against these term factors give the sentence its mixture, and the sentences together that of the document.

Terms are those of at least one in ``one_in`` documents, counted over all documents: their number is at most ``one_in``
times the mean number of terms of a document, however many documents there are, and that (terms x components) is what
reaches the driver and goes back. Documents are tokenised once; every pass reads the word numbers written down then.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import cut_lineage

SHARED = 3  # components without an area: what the seeds leave unexplained, and what Hangul and other texts share
AT_ONCE = 250_000  # words worked on together
HELD = 2_000_000  # entries of a task's sums, beyond which they are added up or passed on
TOKEN = re.compile(r"[^\W\d_]+|[.!?。！？](?=\s)|\n")
# Particles and endings that are cut off a Korean word, longer ones first.
ENDINGS = re.compile(
    r"(?<=[가-힣]{2})(?:으로부터|에서부터|이라는|에서는|으로는|까지는|보다는|에서도|이지만|에서|에게|으로|부터|까지|보다|처럼|이다|이며|이고|에는|와는|과는|만큼|마다|라는|로는|을|를|은|는|이|가|의|에|로|와|과|도|만|며|고)$"
)


class Encoder:
    """Texts as numbers of word stems; 0 ends a sentence."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {c: 0 for c in ".!?。！？\n"}

    def number(self, word: str) -> int:
        """A hash of the stem (odd if the stem is a single letter and no term itself)."""
        if len(self.known) > 1 << 20:
            self.__init__()
        stem = ENDINGS.sub("", word)
        found = self.known[word] = (xxhash.xxh32_intdigest(stem.encode("utf-8", "surrogatepass")) | 2) & ~1 | (len(stem) < 2)
        return found

    def words(self, text: str) -> list[int]:
        get, number = self.known.get, self.number
        out = []
        for word in TOKEN.findall(text.lower()):
            n = get(word)
            out.append(number(word) if n is None else n)
        return out


def terms_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and sentence of every term (stems and pairs of neighbouring ones), in order, and the text of every sentence.

    ``words`` are the numbers of all texts one after the other, ``sizes`` how many each has. Sentences without a word
    are not counted.
    """
    text = np.repeat(np.arange(len(sizes)), sizes)
    words = words.astype(np.uint64)
    is_word = words > 0
    first = np.ones(len(words), bool)
    first[1:] = (text[1:] != text[:-1]) | ~is_word[:-1]
    fresh = is_word & first
    sentence = np.cumsum(fresh) - 1
    single = is_word & (words & np.uint64(1) == 0)
    pair = np.zeros(len(words), bool)
    pair[1:] = is_word[1:] & ~first[1:]
    hashes = np.zeros((len(words), 2), np.uint64)
    hashes[:, 0] = words * np.uint64(0xD6E8FEB86659FD93)
    hashes[1:, 1] = words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    wanted = np.stack((single, pair), axis=1)
    return (hashes ^ (hashes >> np.uint64(32)))[wanted], np.repeat(sentence, 2)[wanted.ravel()], text[fresh]


def group_sums(values: np.ndarray, owner: np.ndarray, groups: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their sorted ``owner``."""
    out = np.zeros((groups, *values.shape[1:]), values.dtype)
    if len(owner):
        begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out[owner[begins]] = np.add.reduceat(values, begins, axis=0)
    return out


class Sums:
    """Rows of numbers added up by key, passed on in parts of bounded size."""

    def __init__(self, names: list[str], kind: type):
        self.names, self.kind, self.size = names, kind, 0
        self.keys: list[np.ndarray] = []
        self.values: list[np.ndarray] = []

    def add(self, keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.values.append(values)
        self.size += len(keys)
        if self.size > HELD:
            self.merge()
            if self.size > HELD // 2:
                yield self.batch()

    def merge(self) -> None:
        if self.size:
            keys, values = np.concatenate(self.keys), np.concatenate(self.values)
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
            begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            self.keys, self.values, self.size = [keys[begins]], [np.add.reduceat(values, begins, axis=0)], len(begins)

    def batch(self) -> pa.RecordBatch:
        self.merge()
        keys = self.keys[0] if self.keys else np.zeros(0, np.uint64)
        values = self.values[0] if self.values else np.zeros((0, len(self.names)), self.kind)
        self.keys, self.values, self.size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[pa.array(values[:, c].astype(self.kind)) for c in range(len(self.names))]], ["term", *self.names])


class Vocabulary:
    """The counted terms, as sorted hashes with their occurrences."""

    def __init__(self, hashes: np.ndarray, uses: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.uses = hashes[order], uses[order]

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms, and the number of each of these."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        there = self.hashes[at] == hashes
        return there, at[there]


class Model:
    """Term factors of the areas' and the shared components (each component sums to one)."""

    def __init__(self, areas: list[str], vocabulary: Vocabulary, terms: np.ndarray):
        self.areas, self.vocabulary, self.terms = areas, vocabulary, terms.astype(np.float32)

    def starting(self, labels: list[list[str] | None]) -> np.ndarray:
        """Starting row factors: all components, or for labelled rows those of the labels and the shared ones."""
        start = np.ones((len(labels), len(self.areas) + SHARED), np.float32)
        place = {a: i for i, a in enumerate(self.areas)}
        for row, names in enumerate(labels):
            if names is not None and any(n in place for n in names):
                start[row, : len(self.areas)] = [a in names for a in self.areas]
        return start / start.sum(axis=1, keepdims=True)

    def sums(self, words: np.ndarray, sizes: np.ndarray, labels: list, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """What these documents add to the term factors: row factors by multiplicative updates, then their shares."""
        hashes, sentence, text = terms_of(words, sizes)
        there, term = self.vocabulary.find(hashes)
        owner = text[sentence[there]]
        factors, of_terms = self.starting(labels), self.terms[term]
        for i in range(rounds + 1):
            share = factors[owner] * of_terms
            share /= share.sum(axis=1, keepdims=True) + 1e-12
            if i < rounds:
                factors = group_sums(share, owner, len(sizes))
                factors /= factors.sum(axis=1, keepdims=True) + 1e-12
        order = np.argsort(term, kind="stable")
        used = np.unique(term)
        return used, group_sums(share[order], np.searchsorted(used, term[order]), len(used))

    def anchored(self) -> np.ndarray:
        """Term factors of the areas and a background component; each term's sum to one.

        An area keeps a term if it has more than two fifths of all areas' use of it, and more use of it than what the
        seeds leave unexplained; the other areas' parts are background.
        """
        of_areas, unexplained = self.terms[:, : len(self.areas)], self.terms[:, len(self.areas)][:, None]
        part = of_areas / (of_areas.sum(axis=1, keepdims=True) + 1e-30)
        part = np.where((part > 0.4) & (of_areas > unexplained), part, 0)
        return np.concatenate((part, 1 - part.sum(axis=1, keepdims=True)), axis=1).astype(np.float32)

    def mixtures(self, anchored: np.ndarray, words: np.ndarray, sizes: np.ndarray, rounds: int, background: float, clear: float) -> list[dict[str, float]]:
        """Share of its sentences that each area has of each text.

        A sentence deals with the area of its largest row factor, found by ``rounds`` multiplicative updates. One where no
        area has ``clear`` terms goes with the sentence before it (at the start, with the first clear one). A text
        without any clear sentence has no area.
        """
        hashes, sentence, text = terms_of(words, sizes)
        there, term = self.vocabulary.find(hashes)
        owner, of_terms = sentence[there], anchored[term]
        areas = len(self.areas)
        weight = np.ones(areas + 1, np.float32)
        weight[areas] = background
        factors = np.ones((len(text), areas + 1), np.float32)
        for _ in range(rounds):
            share = (factors / (factors.sum(axis=1, keepdims=True) + 1e-12) * weight)[owner] * of_terms
            share /= share.sum(axis=1, keepdims=True) + 1e-12
            factors = group_sums(share, owner, len(text))
        own_areas = factors[:, :areas]
        chosen = np.where(own_areas.max(axis=1) >= clear, own_areas.argmax(axis=1), -1) if own_areas.size else np.full(len(text), -1)
        out: list[dict[str, float]] = [{} for _ in sizes]
        bounds = np.searchsorted(text, np.arange(len(sizes) + 1))
        for i, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
            own = chosen[low:high]
            known = np.flatnonzero(own >= 0)
            if len(known):
                last = np.maximum.accumulate(np.where(own >= 0, np.arange(len(own)), -1))
                filled = own[np.where(last < 0, known[0], last)]
                for area, n in zip(*np.unique(filled, return_counts=True)):
                    out[i][self.areas[area]] = float(n / len(own))
        return out


def is_other_script(text: str) -> bool:
    """More letters of other scripts than Hangul ones."""
    hangul = sum("가" <= c <= "힣" for c in text)
    return 2 * hangul < sum(map(str.isalpha, text))


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word numbers in place of the text, and for labelled rows whether its script is another than Hangul."""
    encoder = Encoder()
    for batch in batches:
        texts, labels = batch.column("text").to_pylist(), batch.column("labels")
        words = pa.array([np.array(encoder.words(t), np.uint32).view(np.int32) for t in texts], pa.list_(pa.int32()))
        other = pa.array([bool(own and is_other_script(t)) for t, own in zip(texts, labels.to_pylist())])
        yield pa.RecordBatch.from_arrays([batch.column("id"), labels, other, words], ["id", "labels", "other", "words"])


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches of about ``AT_ONCE`` words, with all their words and how many each row has."""
    for batch in batches:
        column = batch.column("words")
        ends = column.offsets.to_numpy().astype(np.int64)
        low = 0
        for high in range(1, batch.num_rows + 1):
            if high == batch.num_rows or ends[high] - ends[low] >= AT_ONCE:
                words = column.values.to_numpy()[ends[low] : ends[high]].view(np.uint32)
                yield batch.slice(low, high - low), words, np.diff(ends[low : high + 1])
                low = high


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and occurrences of every term."""
    total = Sums(["docs", "uses"], np.int64)
    for _, words, sizes in parts_of(batches):
        hashes, sentence, text = terms_of(words, sizes)
        owner = text[sentence]
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        own = new.copy()
        own[1:] |= owner[1:] != owner[:-1]
        group = np.cumsum(new) - 1
        uses = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        docs = np.bincount(group, own).astype(np.int64) if len(group) else uses
        yield from total.add(hashes[new], np.stack((docs, uses), axis=1))
    yield total.batch()


def vocabulary_of(rows: DataFrame, one_in: int) -> Vocabulary:
    """The terms of two documents at least and of at least one in ``one_in``."""
    least = max(2, -(-rows.count() // one_in))
    found = rows.select("words").mapInArrow(counted, "term long, docs long, uses long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses"))
    found = found.filter(F.col("docs") >= least).select("term", "uses").toPandas()
    return Vocabulary(found["term"].to_numpy(np.int64).view(np.uint64), found["uses"].to_numpy(np.float64))


def term_sums(rows: DataFrame, areas: list[str], vocabulary: Vocabulary, model: Model | None, rounds: int) -> np.ndarray:
    """One alternating update: row factors of all rows, and the sum of what they add to the term factors.

    Without a model the labels are the factors: each labelled row adds its terms to its areas' components and to what its
    script shares.
    """
    width = len(areas) + SHARED
    shipped = rows.sparkSession.sparkContext.broadcast((areas, vocabulary, model))
    columns = [f"c{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, held = shipped.value
        place, total = {a: i for i, a in enumerate(names)}, Sums(columns, np.float32)
        for part, words, sizes in parts_of(batches):
            labels = part.column("labels").to_pylist()
            if held is not None:
                used, values = held.sums(words, sizes, labels, rounds)
            else:
                weight = np.zeros((len(labels), width), np.float32)
                for row, (own, other) in enumerate(zip(labels, part.column("other").to_pylist())):
                    weight[row, len(names) + 1 + other] = 1
                    for name in own:
                        if name in place:
                            weight[row, place[name]] = 1 / len(own)
                hashes, sentence, text = terms_of(words, sizes)
                there, term = known.find(hashes)
                order = np.argsort(term, kind="stable")
                used = np.unique(term)
                values = group_sums(weight[text[sentence[there]][order]], np.searchsorted(used, term[order]), len(used))
            yield from total.add(used.astype(np.uint64), values)
        yield total.batch()

    wanted = rows if model is not None else rows.filter("labels IS NOT NULL")
    schema = "term long, " + ", ".join(f"{c} float" for c in columns)
    found = wanted.select("labels", "other", "words").mapInArrow(run, schema).groupBy("term").agg(*[F.sum(c).cast("float").alias(c) for c in columns]).toPandas()
    out = np.zeros((len(vocabulary), width))
    out[found["term"].to_numpy(np.int64)] = found[columns].to_numpy(np.float64)
    return out


def normalized(sums: np.ndarray) -> np.ndarray:
    sums = sums + 1e-3
    return sums / sums.sum(axis=0, keepdims=True)


def fit(rows: DataFrame, areas: list[tuple[str, str]], updates: int, rounds: int, hold: float, one_in: int) -> Model:
    """The model after ``updates`` passes over all encoded rows; the seeds stay in it with the weight ``hold``.

    Seeds are the descriptions and the labelled rows. What all rows use more than twice as often as the labelled ones do
    seeds the component of the unexplained, such as texts of no area.
    """
    names = [a for a, _ in areas]
    vocabulary = vocabulary_of(rows, one_in)
    seeds = term_sums(rows, names, vocabulary, None, rounds)
    encoder = Encoder()
    for i, (_, description) in enumerate(areas):
        parts = [encoder.words(p) for p in re.split(r"[,;\n]", description or "") if p.strip()]
        hashes, _, _ = terms_of(np.array([n for p in parts for n in p], np.uint32), np.array([len(p) for p in parts], np.int64))
        seeds[:, i] += 20 * np.bincount(vocabulary.find(hashes)[1], minlength=len(vocabulary))
    labelled = seeds[:, len(names) + 1 :].sum(axis=1)
    size = max(labelled.sum(), 1)
    seeds[:, len(names)] = np.maximum(0, vocabulary.uses / max(vocabulary.uses.sum(), 1) - 2 * labelled / size) * size
    model = Model(names, vocabulary, normalized(seeds))
    for _ in range(updates):
        model = Model(names, vocabulary, normalized(term_sums(rows, names, vocabulary, model, rounds) + hold * seeds))
    return model


def label_lists(labels: DataFrame, id_column: str, label_column: str, max_labelled: int) -> DataFrame:
    """(id, labels) of the labelled documents; of more than about ``max_labelled`` a part chosen by the hash of the id."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("string").alias("a")).dropna()
    many = known.agg(F.approx_count_distinct("id")).first()[0]
    if many > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * max_labelled / many)))
    return known.groupBy("id").agg(F.array_sort(F.collect_set("a")).alias("labels"))


def subject_mixtures(
    df: DataFrame,
    id_column: str,
    text_column: str,
    areas: DataFrame,
    area_column: str,
    description_column: str,
    labels: DataFrame,
    label_id_column: str,
    label_column: str,
    updates: int = 1,
    rounds: int = 3,
    hold: float = 3.0,
    sentence_rounds: int = 2,
    background: float = 0.3,
    clear: float = 1.25,
    one_in: int = 10_000,
    max_areas: int = 200,
    max_labelled: int = 200_000,
) -> DataFrame:
    """id, area and share (of the document's sentences) for every area a document deals with.

    Null and empty texts and those without a clear sentence have no row. Repeated rows come out once. Labels of unknown
    areas or documents are ignored; without labels the descriptions alone are the seeds; without areas the result is
    empty. More than ``max_areas`` areas raise an error; of more than ``max_labelled`` labelled documents about as many
    are seeds. Other columns are ignored.
    """
    listed = areas.select(F.col(area_column).cast("string").alias("a"), F.col(description_column).cast("string").alias("d")).filter("a IS NOT NULL").distinct().limit(max_areas + 1).collect()
    if len(listed) > max_areas:
        raise ValueError(f"more than {max_areas} areas")
    texts = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter(F.length("text") > 0)
    known = F.broadcast(label_lists(labels, label_id_column, label_column, max_labelled))
    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.join(known, "id", "left").mapInArrow(encoded, f"id {kind}, labels array<string>, other boolean, words array<int>")
    rows = cut_lineage(rows)
    model = fit(rows, sorted((r.a, r.d or "") for r in listed), updates, rounds, hold, one_in) if listed else Model([], Vocabulary(np.zeros(0, np.uint64), np.zeros(0)), np.ones((0, SHARED)))
    shipped = df.sparkSession.sparkContext.broadcast((model, model.anchored()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, anchored = shipped.value
        for part, words, sizes in parts_of(batches):
            owners, names, shares = [], [], []
            for row, mixture in enumerate(held.mixtures(anchored, words, sizes, sentence_rounds, background, clear)):
                for area, share in mixture.items():
                    owners.append(row)
                    names.append(area)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(owners, pa.int64())), pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["id", "area", "share"])

    return rows.select("id", "words").mapInArrow(run, f"id {kind}, area string, share double").dropDuplicates(["id", "area"])
