"""The language of documents and of their lines, whatever their labels say (problem 8).

String-kernel classification. Two strings are compared by the letter n-grams of one to three signs that both contain (presence,
not number: the blended spectrum), normalized by the sizes of their sets. Landmarks are labelled sentences; the kernel of a
string with all landmarks, whitened by the landmarks' own kernel, are its Nystrom features, and one-versus-rest kernel ridge
regression over them gives a score for each language. As the presence kernel is linear in the n-grams, landmarks and
coefficients multiply out once to a matrix of n-gram buckets by languages, and a batch of lines is scored by one product of
its sparse presence matrix with it.

A document's language is that which most letters of its lines are in. A line stands out only if its own language beats the
document's by a margin. Keys, digests and encoded data that exports leave are in no language: they neither train nor vote.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm._arrow import small_batches

BUCKET_BITS = 18
MAX_LANDMARKS = 600
MAX_TRAINING = 6000
MIN_LETTERS = 20
MARGIN = 0.1
#: What the scores are multiplied by for the confidence, if a model has none of its own from held-out samples.
SHARPNESS = 6.0
SHARPNESSES = (1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0, 48.0)
RIDGE = 1e-3
#: The shortest unbroken run that may be a digest, a key or encoded data, if there are figures among its letters.
MACHINE_RUN = 32
_MACHINE = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]{0,64}[0-9])[A-Za-z0-9+/=_-]{%d,}" % MACHINE_RUN)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each code point 1 for a letter (category L), 2 for a mark (M), else 0; built from the Unicode data."""
    import unicodedata

    out = np.zeros(0x110000, dtype=np.uint8)
    for lo, hi in ((0, 0x20000), (0x20000, 0x32400)):
        kinds = [unicodedata.category(chr(c))[0] for c in range(lo, hi)]
        out[lo:hi] = [1 if k == "L" else 2 if k == "M" else 0 for k in kinds]
    return out


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def presence(lines: list[str], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line numbers, buckets, letters of each line): the distinct n-grams of each line, in order of lines.

    n-grams are of lower-case letters and marks; whatever else stands between words counts as one space. known: only these
    buckets count.
    """
    cp = _code_points("".join(f" {line}\n" for line in lines).lower())
    kind = _classes()[cp]
    is_break = cp == 10
    line = np.cumsum(is_break, dtype=np.int64) - is_break
    letters = np.bincount(line[kind == 1], minlength=len(lines)) if len(cp) else np.zeros(len(lines), dtype=np.int64)
    space = kind == 0
    keep = ~space
    if len(cp):
        keep[0] = True
        keep[1:] |= ~space[:-1] | is_break[:-1]  # the first of a run of other signs stands for the run
    c = np.where(space, 32, cp)[keep].astype(np.uint64)
    line = line[keep]
    first = (c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(7)
    parts_l, parts_b = [], []
    h = None
    for n in (1, 2, 3):
        if n == 1:
            h = first.copy()
        else:
            h = (h[:-1] * np.uint64(0xD6E8FEB86659FD93) + first[n - 1 :]) ^ np.uint64(n)
        m = len(h)
        if m <= 0:
            break
        bucket = ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        same = line[:m] == line[n - 1 :] if n > 1 else np.ones(m, dtype=bool)
        use = same & (c[:m] != 32) if n == 1 else same & ((c[:m] != 32) | (c[1 : m + 1] != 32))
        if known is not None:
            use &= known[bucket]
        parts_l.append(line[:m][use])
        parts_b.append(bucket[use])
    if not parts_l:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    key = np.concatenate([(a << BUCKET_BITS) | b for a, b in zip(parts_l, parts_b)])
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1), letters


def _presence_in_parts(lines: list[str], known: np.ndarray, most: int = 500_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """presence of any number of lines of any length, at most about `most` code points at a time."""
    if sum(map(len, lines)) <= most:
        return presence(lines, known)
    rows, buckets = [], []
    letters = np.zeros(len(lines), dtype=np.int64)
    start = 0
    while start < len(lines):
        stop, size = start, 0
        while stop < len(lines) and (stop == start or size + len(lines[stop]) <= most):
            size += len(lines[stop])
            stop += 1
        if stop == start + 1 and size > most:
            line, found = lines[start], []
            for k in range(0, len(line), most):
                _, part, n = presence([line[k : k + most]], known)
                found.append(part)
                letters[start] += n[0]
            part = np.unique(np.concatenate(found))
            rows.append(np.full(len(part), start))
            buckets.append(part)
        else:
            r, b, n = presence(lines[start:stop], known)
            rows.append(r + start)
            buckets.append(b)
            letters[start:stop] = n
        start = stop
    return np.concatenate(rows), np.concatenate(buckets), letters


class Model:
    """languages, and weights by n-gram bucket and language; known: the buckets that any landmark has.

    sharpness: what the scores are multiplied by before they are made shares of one.
    """

    def __init__(self, languages: list[str], weights: np.ndarray, known: np.ndarray, sharpness: float = SHARPNESS):
        self.languages, self.weights, self.known, self.sharpness = languages, weights, known, sharpness

    def __getstate__(self) -> tuple:
        used = np.flatnonzero(self.known)
        return self.languages, used.astype(np.int32), self.weights[used], self.sharpness

    def __setstate__(self, state: tuple) -> None:
        self.languages, used, rows, self.sharpness = state
        self.weights = np.zeros((1 << BUCKET_BITS, len(self.languages)), dtype=np.float32)
        self.weights[used] = rows
        self.known = np.zeros(1 << BUCKET_BITS, dtype=bool)
        self.known[used] = True

    def scores(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores of each line by language, letters of each line). A line without a known n-gram scores 0 for all."""
        rows, buckets, letters = _presence_in_parts(lines, self.known)
        out = np.zeros((len(lines), len(self.languages)), dtype=np.float32)
        if len(rows):
            starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            sums = np.add.reduceat(self.weights[buckets], starts, axis=0)[:, : len(self.languages)]
            counts = np.diff(np.concatenate([starts, [len(rows)]]))
            out[rows[starts]] = sums / np.sqrt(counts)[:, None]
        return out, letters


def fit(samples: list[tuple[str, str]], *, landmarks: int = MAX_LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model of (language, text) samples. Landmarks are taken evenly from each language, in the order of their texts."""
    samples = sorted({(lang, text) for lang, text in samples if lang and text})
    if not samples:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(1 << BUCKET_BITS, bool))
    languages = sorted({lang for lang, _ in samples})
    by = {lang: [i for i, s in enumerate(samples) if s[0] == lang] for lang in languages}
    each = max(1, landmarks // len(languages))
    marks = sorted(i for own in by.values() for i in (own if len(own) <= each else [own[int(j * len(own) / each)] for j in range(each)]))
    used = np.unique(presence([_one_line(samples[i][1]) for i in marks])[1])
    known = np.zeros(1 << BUCKET_BITS, dtype=bool)
    known[used] = True

    def normalized(texts: list[str]) -> np.ndarray:
        rows, buckets, _ = presence(texts, known)
        dense = np.zeros((len(texts), len(used)), dtype=np.float32)
        dense[rows, np.searchsorted(used, buckets)] = 1
        return dense / np.sqrt(np.maximum(dense.sum(1, keepdims=True), 1))

    at_marks = normalized([_one_line(samples[i][1]) for i in marks])
    kmm = (at_marks @ at_marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kmm)
    good = values > 1e-6 * values[-1]
    white = vectors[:, good] / np.sqrt(values[good])
    n = len(samples)
    blocks = [normalized([_one_line(t) for _, t in samples[k : k + 256]]) @ at_marks.T for k in range(0, n, 256)]
    features = np.concatenate(blocks).astype(np.float64) @ white
    weight = np.zeros(n)
    for own in by.values():
        weight[own] = n / (len(languages) * len(own))  # each language counts alike
    target = np.array([[1.0 if s[0] == lang else -1.0 / max(1, len(languages) - 1) for lang in languages] for s in samples])
    gram = features.T @ (features * weight[:, None]) + ridge * n * np.eye(features.shape[1])
    coefficients = np.linalg.solve(gram, features.T @ (target * weight[:, None]))
    wide = np.zeros((1 << BUCKET_BITS, len(languages)), dtype=np.float32)
    wide[used] = at_marks.T @ (white @ coefficients)
    return Model(languages, wide, known)


def _one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def without_machine_runs(text: str) -> str:
    """text with a space for each digest, key or run of encoded data; its line feeds stay where they are."""
    if len(max(text.split(), key=len, default="")) < MACHINE_RUN:
        return text
    return _MACHINE.sub(" ", text)


def calibrated(samples: list[tuple[str, str]], *, landmarks: int = MAX_LANDMARKS, held_out: int = 5) -> float:
    """The sharpness with which a model of most samples gives the others the least surprise; SHARPNESS if there are too few."""
    samples = sorted(set(samples))
    kept, asked = [s for k, s in enumerate(samples) if k % held_out], samples[::held_out]
    known = {lang for lang, _ in kept}
    asked = [s for s in asked if s[0] in known]
    if len(known) < 2 or len(asked) < 2 * len(known):
        return SHARPNESS
    model = fit(kept, landmarks=landmarks)
    scores, _ = model.scores([_one_line(t) for _, t in asked])
    right = np.array([model.languages.index(lang) for lang, _ in asked])
    surprise = [-np.log(np.maximum(_softmax(scores, k)[np.arange(len(right)), right], 1e-9)).mean() for k in SHARPNESSES]
    return SHARPNESSES[int(np.argmin(surprise))]


def confirmed(model: Model, labelled: list[tuple[str, str]], *, per_language: int, doubt: float = 0.25, line_chars: int = 300) -> list[tuple[str, str]]:
    """Lines to train on from documents with labels of uneven worth: those of documents that the model finds in their own language.

    A line that the model puts into another language by more than doubt is left out. At most per_language lines for each
    language, spread evenly over the sorted lines, each cut to line_chars.
    """
    pool: dict[str, set[str]] = {}
    for label, text in labelled:
        if label not in model.languages:
            continue
        lines = [x for x in without_machine_runs(text).split("\n") if x.strip()]
        scores, letters = model.scores(lines)
        if not len(lines) or model.languages[int(np.bincount(scores.argmax(1), weights=letters, minlength=len(model.languages)).argmax())] != label:
            continue
        own = scores[:, model.languages.index(label)]
        for k in np.flatnonzero((letters >= MIN_LETTERS) & (scores.max(1) - own <= doubt)):
            pool.setdefault(label, set()).add(lines[k][:line_chars])
    out = []
    for label, found in sorted(pool.items()):
        ordered = sorted(found)
        take = min(per_language, len(ordered))
        out += [(label, ordered[int(j * len(ordered) / take)]) for j in range(take)]
    return out


def norm_label(label) -> F.Column:
    """A label trimmed, in lower case and cut to its first two characters."""
    return F.substring(F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")), 1, 2)


def train(
    samples: DataFrame,
    docs: DataFrame | None = None,
    *,
    sample_docs: int = 2000,
    per_language: int = 400,
    landmarks: int = MAX_LANDMARKS,
    most_samples: int = MAX_TRAINING,
    doc_chars: int = 16_000,
    doc_lines: int = 40,
    line_chars: int = 400,
    least_chars: int = 200,
    label_col: str = "lang",
    text_col: str = "text",
    id_col: str = "doc_id",
) -> Model:
    """Fits on at most most_samples labelled samples and, from docs, on lines of at most sample_docs documents.

    The documents are those of the least hashes of their ids among labelled ones of more than least_chars code points; of each
    at most doc_lines lines of line_chars code points of its first doc_chars. Their labels only count where the model of the
    samples agrees. This sample is all that comes to the driver, and only the fit is bounded by it: every text is scored whole.
    """
    first = [(r[0], r[1]) for r in samples.select(norm_label(F.col(label_col)), text_col).where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).orderBy(F.xxhash64(text_col)).limit(most_samples).collect()]
    model = fit(first, landmarks=landmarks)
    if docs is None or not model.languages:
        return model
    part = F.array_join(F.transform(F.slice(F.split(F.substring(text_col, 1, doc_chars), "\n"), 1, doc_lines), lambda x: F.substring(x, 1, line_chars)), "\n")
    # Only hashes under a bound that leaves about twice as many documents as are wanted: what is sorted does not grow with docs.
    bound = min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 2 * sample_docs / max(1, docs.count()))))
    ids = docs.withColumn("_h", F.xxhash64(id_col, F.lit(11))).where((F.col("_h") <= bound) & F.col(label_col).isNotNull() & (F.length(text_col) > least_chars))
    rows = ids.select(norm_label(F.col(label_col)).alias("label"), part.alias("part"), "_h").orderBy("_h").limit(sample_docs).select("label", "part").collect()
    every = first + confirmed(model, [(r[0], r[1]) for r in rows], per_language=per_language)
    model = fit(every, landmarks=landmarks)
    model.sharpness = calibrated(every, landmarks=landmarks)
    return model


def _letters(text: str) -> int:
    return int((_classes()[_code_points(text)] == 1).sum())


def _softmax(scores: np.ndarray, sharpness: float = SHARPNESS) -> np.ndarray:
    e = np.exp(sharpness * (scores - scores.max(axis=-1, keepdims=True)))
    return e / e.sum(axis=-1, keepdims=True)


def languages_of(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", margin: float = MARGIN) -> DataFrame:
    """(doc_id, line_no, language, confidence, letters, label): line_no 0 for each document, and each line in another language.

    Lines stand between line feeds and count from 1, blank ones included. A line has a row if it has MIN_LETTERS letters and its
    language beats the document's by margin. Digests, keys and encoded data (without_machine_runs) have no language: they do
    not vote for their document's, and their letters do not count for a line. letters is the number of letters of the
    document, of whatever kind, or of the line; label is the document's own label trimmed, in lower case and cut to two
    characters. A text without any known n-gram, a null, an empty and a blank text have null language and confidence 0. A row
    for each row of docs; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("language", pa.string()), ("confidence", pa.float64()), ("letters", pa.int64()), ("label", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*model.languages, None]
        for batch in small_batches(batches, "text", 1 << 20):
            texts = batch.column(1).to_pylist()
            lines: list[str] = []
            first = [0]
            machine = np.zeros(len(texts), np.int64)
            for j, t in enumerate(texts):
                words = without_machine_runs(t) if t else ""
                if t and len(words) != len(t):
                    machine[j] = _letters(t) - _letters(words)
                lines += words.split("\n")
                first.append(len(lines))
            scores, letters = model.scores(lines)
            k = len(model.languages)
            best = scores.argmax(1) if k else np.zeros(len(lines), np.int64)
            best = np.where(scores.any(1), best, k) if k else best
            owner = np.repeat(np.arange(len(texts)), np.diff(first))
            votes = np.zeros((len(texts), k + 1))
            np.add.at(votes, (owner, best), letters + 1e-6)
            votes[:, k] = 0
            main = np.where(votes.any(1), votes.argmax(1), k)
            total = np.bincount(owner, weights=letters, minlength=len(texts)).astype(np.int64)
            weighted = np.zeros((len(texts), k))
            np.add.at(weighted, owner, scores * (letters[:, None] + 1e-6))
            sure = _softmax(weighted / np.maximum(total, 1e-6)[:, None], model.sharpness) if k else np.zeros((len(texts), 0))
            sure = np.concatenate([sure, np.zeros((len(texts), 1))], axis=1)
            padded = np.concatenate([scores, np.full((len(lines), 1), np.inf, np.float32)], axis=1)
            at = np.arange(len(lines))
            with np.errstate(invalid="ignore"):
                other = np.flatnonzero((letters >= MIN_LETTERS) & (best < k) & (best != main[owner]) & (padded[at, best] - padded[at, main[owner]] >= margin))
            own = np.arange(len(texts))
            line_sure = _softmax(scores[other], model.sharpness)[np.arange(len(other)), best[other]] if len(other) else np.zeros(0)
            pick = pa.array(np.concatenate([own, owner[other]]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pick),
                    pa.array(np.concatenate([np.zeros(len(texts)), other - np.asarray(first)[owner[other]] + 1]).astype(np.int32)),
                    pa.array([names[j] for j in np.concatenate([main, best[other]])], pa.string()),
                    pa.array(np.concatenate([sure[own, main], line_sure])),
                    pa.array(np.concatenate([total + machine, letters[other]])),
                    batch.column(2).take(pick),
                ],
                schema=schema,
            )

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), norm_label(F.col(label_col)).alias("label"))
    return picked.mapInArrow(run, "doc_id bigint, line_no int, language string, confidence double, letters bigint, label string")


def wrong_labels(found: DataFrame) -> DataFrame:
    """(doc_id, line_no, language) of languages_of: documents with MIN_LETTERS letters whose label is null or another, and all lines."""
    wrong = F.col("label").isNull() | (F.col("label") != F.col("language"))
    return found.where((F.col("line_no") > 0) | ((F.col("letters") >= MIN_LETTERS) & F.col("language").isNotNull() & wrong)).select("doc_id", "line_no", "language")
