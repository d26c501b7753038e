"""Toxicity scores from a lexicon, misspellings included, and the words around each hit.

The lexicon is a trie of whole terms and of stems that any ending may follow. For each
word the Levenshtein automaton of the word is run over the trie, branch by branch, and
follows only branches that can still come within the allowed distance. Every hit is then
judged by its context window: one inside quotation marks, or near words that report or
discuss speech, is quotation; one that addresses somebody is abuse. The counts of the
kinds of hits go into a logistic regression learned from labelled rows, from the same
rows with their hits misspelled, and with their hits quoted. A misspelled hit counts as a
learned share of an exact one, so it never lowers a score. Near misses that clean labelled
rows hold are words of their own and no hits.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.features import SAMPLE_ROWS, labelled_sample, minimise, sigmoid
from pairloom.llm.text import ALPHANUMERIC, text_bytes, with_columns, word_hashes, word_places, worker_cache
from pairloom.shared import scratch, write_table

WINDOW = 6  # words before and after a hit that are its context
LEAST_RATIO = 12  # of an entry's share of toxic rows to its share of the others
LEAST_DOCS = 6  # toxic rows of the sample that must have a lexicon entry
RISK = 0.002  # of a clean row to have a near miss of an entry that no other one has; above it the entry is exact
STEM = (4, 5, 6, 7)  # lengths of learned stems
FUZZY_TERM, FUZZY_STEM = 4, 5  # one edit of a shorter entry leaves too little of it: it must match exactly
_MANY = 1 << 30
KNOWN_WORDS = 2_000_000  # remembered by a worker
TEXT_BYTES = 2 << 20

#: Words near a hit that mark quotation or discussion, and address, in the corpus's languages.
REPORTING = frozenset(
    "said says say wrote writes quoted quote quotes called calling word term meaning means "
    "reported report dit dite écrit cité mot terme sagte sagt schrieb zitiert wort begriff "
    "dijo dice escribió citó palabra término".split()
)
ADDRESS = frozenset("you your youre u ur tu toi vous ton ta votre du dich dein ihr euch tú usted ustedes eres".split())
_QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›", "»": "«"}


class Trie:
    """Lexicon as arrays of children; ``whole`` and ``stem`` mark where entries end: 1 for
    one that must match exactly, 2 for one that may be misspelled."""

    def __init__(
        self,
        terms: list[str],
        stems: list[str],
        fuzzy_term: int = FUZZY_TERM,
        fuzzy_stem: int = FUZZY_STEM,
        ordinary: frozenset[str] = frozenset(),
        exact: frozenset[str] = frozenset(),
    ):
        """``exact``: terms, and stems with ``^`` before them, that must match exactly however long they are."""
        self.ordinary = ordinary  # near misses that are words of their own
        self.children: list[dict[str, int]] = [{}]
        self.whole, self.stem, self.parents = [0], [0], [(0, "")]
        for words, marks, fuzzy, sign in ((terms, self.whole, fuzzy_term, ""), (stems, self.stem, fuzzy_stem, "^")):
            for word in words:
                at = 0
                for c in word:
                    if c not in self.children[at]:
                        self.children[at][c] = len(self.children)
                        self.children.append({})
                        self.parents.append((at, c))
                        self.whole.append(0)
                        self.stem.append(0)
                    at = self.children[at][c]
                marks[at] = 2 if len(word) >= fuzzy and sign + word not in exact else 1

    def distance(self, word: str, allowed: int) -> int | None:
        """Smallest edit distance, up to ``allowed``, of the word to a term, or of a
        beginning of the word to a stem; null if there is none.

        Insertions, deletions, substitutions and swaps of neighbours cost 1.
        """
        return next((k for k in range(allowed + 1) if self._entry(word, k)), None)

    def near(self, word: str) -> str | None:
        """An entry one edit away, a stem with ``^`` before it; null if there is none."""
        return self._entry(word, 1) or None

    def _entry(self, word: str, allowed: int) -> str:
        """Walk automaton and trie together to an entry, or return an empty text. A state is a node of the trie, the letters
        read, and the edits left; without edits left only the word's own branch is open."""
        n = len(word)
        todo, seen = [(0, 0, allowed)], set()
        while todo:
            state = todo.pop()
            node, i, left = state
            least = 1 if left == allowed else 2  # 2: an edit is used
            if self.stem[node] >= least:
                return "^" + self._spelled(node)
            if self.whole[node] >= least and i == n:
                return self._spelled(node)
            if left:
                if state in seen:
                    continue
                seen.add(state)
            children = self.children[node]
            if i < n and word[i] in children:
                todo.append((children[word[i]], i + 1, left))
            if left:
                if i < n:
                    todo.append((node, i + 1, left - 1))
                for child in children.values():
                    todo.append((child, i, left - 1))
                    if i < n:
                        todo.append((child, i + 1, left - 1))
                if i + 1 < n and word[i + 1] in children and word[i] in self.children[children[word[i + 1]]]:
                    todo.append((self.children[children[word[i + 1]]][word[i]], i + 2, left - 1))
        return ""

    def _spelled(self, node: int) -> str:
        letters = []
        while node:
            node, letter = self.parents[node]
            letters.append(letter)
        return "".join(reversed(letters))

    def fields(self) -> tuple:
        return self.children, self.parents, self.whole, self.stem, self.ordinary

    @staticmethod
    def received(fields: tuple) -> Trie:
        trie = object.__new__(Trie)
        trie.children, trie.parents, trie.whole, trie.stem, trie.ordinary = fields
        return trie


def kind_of(trie: Trie, word: str) -> int:
    """0 no hit, 1 an entry itself, 2 a misspelled one."""
    found = trie.distance(word.lower(), 1)
    return 0 if found is None or (found and word.lower() in trie.ordinary) else found + 1


class Halves:
    """A quick test that every hit passes and most words fail.

    One edit leaves one half of an entry whole: the left one at the word's beginning, or
    the right one in its place or next to it. A swap over the middle is undone first.
    """

    def __init__(self, trie: Trie):
        self.lefts: dict[int, set[str]] = {}
        self.rights: dict[tuple[int, int], set[str]] = {}
        todo = [(0, "")]
        while todo:
            node, entry = todo.pop()
            if trie.whole[node] or trie.stem[node]:
                m = len(entry) // 2
                self.lefts.setdefault(m, set()).add(entry[:m])
                self.rights.setdefault((m, len(entry) - m), set()).add(entry[m:])
            todo += [(child, entry + c) for c, child in trie.children[node].items()]

    def may_hit(self, word: str) -> bool:
        for m, known in self.lefts.items():
            if word[:m] in known or (m and word[: m - 1] + word[m : m + 1] in known):
                return True
        for (m, n), known in self.rights.items():
            if word[m : m + n] in known or word[m + 1 : m + 1 + n] in known or (m and word[m - 1 : m - 1 + n] in known):
                return True
        return False


def _kinds(words: list[str], trie: Trie) -> np.ndarray:
    """``kind_of`` for many words."""
    halves = Halves(trie)
    return np.array([kind_of(trie, w) if halves.may_hit(w.lower()) else 0 for w in words], dtype=np.int8)


COUNTS = ["plain", "misspelled", "quoted", "reported", "addressed"]


def _in_quotes(text: str) -> np.ndarray:
    """For each character, whether it is between a pair of quotation marks on one line."""
    inside = np.zeros(len(text), dtype=bool)
    at = 0
    for line in text.split("\n"):
        i = 0
        while i < len(line):
            close = _QUOTES.get(line[i])
            end = line.find(close, i + 1) if close else -1
            if end > i:
                inside[at + i : at + end] = True
                i = end
            i += 1
        at += len(line) + 1
    return inside


def hits(texts: pa.Array, trie: Trie, lexicon: str) -> tuple[np.ndarray, list[list]]:
    """Per text: counts of hits by kind (columns COUNTS), and the hits (from, to, word,
    kind, weight), with places in characters and the context's weight (1 abuse, 0 quotation).

    A hit counts once: as quoted when it is inside quotation marks, else as reported when
    its window has a word of REPORTING, else as plain or misspelled, and those with a
    word of ADDRESS in the window also as addressed.
    """
    counts = np.zeros((len(texts), len(COUNTS)))
    found: list[list] = [[] for _ in range(len(texts))]
    data, at = text_bytes(texts)
    begins, ends = word_places(data, at, ALPHANUMERIC)
    if not len(begins):
        return counts, found
    words = word_hashes(data, begins, ends, ALPHANUMERIC)
    cache = worker_cache()
    known, kinds = cache.get(("toxicity", lexicon), (np.zeros(0, np.uint64), np.zeros(0, np.int8)))
    if len(known) > KNOWN_WORDS:
        known, kinds = known[:0], kinds[:0]
    distinct, one = np.unique(words, return_index=True)
    place = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
    missing = np.flatnonzero(known[place] != distinct) if len(known) else np.arange(len(distinct))
    if len(missing):
        raw = data.tobytes()
        new = [raw[begins[i] : ends[i]].decode("utf-8", "replace") for i in one[missing]]
        known = np.concatenate([known, distinct[missing]])
        kinds = np.concatenate([kinds, _kinds(new, trie)])
        order = np.argsort(known)
        known, kinds = known[order], kinds[order]
        cache[("toxicity", lexicon)] = known, kinds
    toxic, kind = known[kinds > 0], kinds[kinds > 0]
    if not len(toxic):
        return counts, found
    place = np.minimum(np.searchsorted(toxic, words), len(toxic) - 1)
    hit = np.flatnonzero(toxic[place] == words)
    first = np.searchsorted(begins, at)
    row = np.searchsorted(first, hit, "right") - 1
    for r in np.unique(row):
        own = hit[row == r] if len(hit) < 2000 else hit[np.searchsorted(row, r) : np.searchsorted(row, r, "right")]
        raw = data[at[r] : at[r + 1]].tobytes()
        quoted = _in_quotes(raw.decode("utf-8", "replace"))
        word = lambda i: raw[begins[i] - at[r] : ends[i] - at[r]].decode("utf-8", "replace")  # noqa: E731, B023
        chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        for i in own:
            near = {
                word(j).lower() for j in range(max(first[r], i - WINDOW), min(first[r + 1], i + WINDOW + 1)) if j != i
            }
            start = int(chars[begins[i] - at[r]]) - 1
            k, weight = int(kind[place[i]]), 1.0
            if quoted[min(start, len(quoted) - 1)]:
                counts[r, 2], weight = counts[r, 2] + 1, 0.0
            elif near & REPORTING and not near & ADDRESS:
                counts[r, 3], weight = counts[r, 3] + 1, 0.0
            else:
                counts[r, k - 1] += 1
                counts[r, 4] += bool(near & ADDRESS)
            found[r].append((start, start + len(word(i)), word(i), k, weight))
    return counts, found


#: Weights before any label is seen: a hit is abuse, a misspelled one for 0.6 of an exact
#: one, a quoted one hardly: abuse, share of misspelled, quoted, reported, addressed, constant.
_PRIOR = np.array([4.0, 0.6, 0.5, 0.8, 1.0, -2.5])
_TRUST = 0.002  # of the prior against the mean loss
_SHARES = (1.0, 0.75, 0.5, 0.25)  # of a misspelled hit that the fit chooses from
_HALVES = 2  # of the sample; near misses are judged by the rows of the other one


class Toxicity:
    """A lexicon, near misses that are ordinary words, and the weights of the kinds of hits."""

    def __init__(
        self, terms: list[str], stems: list[str], weights: np.ndarray = _PRIOR, ordinary: Iterable[str] = (), exact: Iterable[str] = ()
    ):
        self.terms, self.stems, self.weights = sorted(terms), sorted(stems), weights
        self.ordinary, self.exact = sorted(ordinary), sorted(exact)

    @property
    def name(self) -> str:
        return hash_of(self.terms, self.stems, self.ordinary, self.exact)

    def trie(self) -> Trie:
        return Trie(self.terms, self.stems, ordinary=frozenset(self.ordinary), exact=frozenset(self.exact))

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return _probability(counts, self.weights)


def hash_of(*parts: list[str]) -> str:
    import hashlib

    return hashlib.sha256("\0".join("\1".join(p) for p in parts).encode()).hexdigest()[:16]


def _inputs(counts: np.ndarray, share: float) -> np.ndarray:
    """What the weights are for: exact and misspelled hits together, quoted, reported,
    addressed (each on a logarithmic scale up to 3), and 1."""
    abuse = counts[:, 0] + share * counts[:, 1]
    z = np.minimum(np.log2(1.0 + np.column_stack([abuse, counts[:, 2:]])), 3.0)
    return np.append(z, np.ones((len(z), 1)), 1)


def _probability(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return sigmoid(_inputs(counts, weights[1]) @ np.delete(weights, 1))


def misspell(word: str) -> str:
    """The word with one edit, chosen by its hash: two letters swapped, one left out, doubled or changed."""
    if len(word) < 3:
        return word
    h = zlib.crc32(word.lower().encode())
    i = 1 + h // 4 % (len(word) - 2)
    return (
        word[:i] + word[i + 1] + word[i] + word[i + 2 :],
        word[:i] + word[i + 1 :],
        word[:i] + word[i] + word[i:],
        word[:i] + "*" * (word[i] == "x") + "x" * (word[i] != "x") + word[i + 1 :],
    )[h % 4]


def _misspelled_counts(counts: np.ndarray, found: list[list], trie: Trie) -> np.ndarray:
    """Counts of the texts with every exact hit that is not quotation misspelled."""
    out = counts.copy()
    kinds: dict[str, int] = {}
    for r, row in enumerate(found):
        for _, _, word, kind, weight in row:
            if kind == 1 and weight:
                if word not in kinds:
                    kinds[word] = kind_of(trie, misspell(word))
                out[r, 0] -= kinds[word] != 1
                out[r, 1] += kinds[word] == 2
    return out


def fit_lexicon(sample: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[list[str], list[str]]:
    """Terms and stems that toxic rows have and others almost never.

    Words of each row are counted once, with their first letters (lengths STEM) as stems.
    Rows that share the smallest hash of three neighbouring words, as copies mostly do,
    count as one.
    An entry must be in ``least_docs`` toxic rows so counted, however many there are, and
    in LEAST_RATIO times as large a share of toxic as of other rows. Terms and stems that
    may be misspelled stay below a kept stem that must match exactly; below one that may be
    misspelled itself, and when they must match exactly, they add nothing and are left out.
    """
    word = F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))

    def beginnings(n: int) -> Column:
        long_ = F.filter("words", lambda w: F.char_length(w) > n)
        return F.transform(long_, lambda w: F.concat(F.lit("^"), F.substring(w, 1, n)))

    three = F.zip_with(
        F.zip_with("all", F.slice("all", 2, _MANY), lambda a, b: F.concat_ws(" ", a, b)),
        F.slice("all", 3, _MANY),
        lambda ab, c: F.xxhash64(F.concat_ws(" ", ab, c)),
    )
    rows = sample.select((F.col("label") > 0).alias("toxic"), word.alias("all")).select(
        "toxic", F.array_distinct("all").alias("words"), F.array_min(three).alias("family")
    )
    stems = [beginnings(n) for n in STEM]
    entries = rows.select("toxic", "family", F.explode(F.array_distinct(F.concat("words", *stems))).alias("entry"))
    count = lambda kind: F.sum(kind.cast("int"))
    counted = entries.distinct().groupBy("entry").agg(
        count(F.col("toxic")).alias("toxic"), count(~F.col("toxic")).alias("other")
    )
    size = rows.select("toxic", "family").distinct().agg(count(F.col("toxic")), count(~F.col("toxic"))).first()
    n_toxic, n_other = size[0] or 0, size[1] or 0
    if not n_toxic or not n_other:
        return [], []
    share = (F.col("toxic") / n_toxic) / ((F.col("other") + 0.5) / n_other)
    # The bounded sample bounds the entries too: each is in least_docs of its rows.
    kept_ = (F.col("toxic") >= least_docs) & (share >= LEAST_RATIO) & (F.char_length("entry") >= 3)
    found = counted.filter(kept_).orderBy(F.col("toxic").desc(), "entry").collect()
    by_stem = {r.entry[1:]: r.toxic for r in found if r.entry.startswith("^")}
    words = {r.entry: r.toxic for r in found if not r.entry.startswith("^")}
    kept: set[str] = set()
    for stem in sorted(by_stem, key=len):
        below = [w for w in words if w.startswith(stem)]
        # A stem of one frequent word is that word; a real stem has several endings.
        one_word = max((words[w] for w in below), default=0) >= 0.7 * by_stem[stem]
        if not one_word and not _covered(stem, kept, FUZZY_STEM):
            kept.add(stem)
    terms = [w for w in words if not _covered(w, kept, FUZZY_TERM)]
    return terms, sorted(kept)


def _covered(entry: str, stems: set[str], fuzzy: int) -> bool:
    """Whether the stems find all words that the entry, fuzzy from so many letters on, finds."""
    least = FUZZY_STEM if len(entry) >= fuzzy else 0
    return any(len(s) >= least and entry.startswith(s) for s in stems)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS
) -> Toxicity:
    """Learn lexicon, ordinary near misses and weights from at most ``rows`` labelled rows where ``train`` holds.

    The driver gets a few numbers and the distinct near misses of each sampled row. For the weights, a row's
    near misses are judged by the other half of the sample, as those of unseen texts are.
    Each toxic row takes part three times more: misspelled (toxic), quoted and reported (not).
    """
    with scratch(docs.sparkSession):
        sample = write_table(labelled_sample(docs, labels, train, label, key, text, rows), "toxicity-sample")
        model = Toxicity(*fit_lexicon(sample))
        sample = sample.withColumn("half", F.pmod(F.xxhash64("key", "label"), F.lit(_HALVES)).cast("int"))
        misses = _near_misses(sample, model).collect()
        model.exact = sorted(_too_common(misses, model))
        by_half = [_ordinary([r for r in misses if r.half != h], model) for h in range(_HALVES)]
        model.ordinary = sorted(_ordinary(misses, model))
        counted = _with_counts(sample, model, by_half).collect()
    counted.sort(key=lambda r: (str(r.key), r.label, r.hits))
    if not counted:
        return model
    x = np.array([r.hits for r in counted])
    y = np.array([r.label > 0 for r in counted], dtype=float)
    whole = np.array([r.altered for r in counted])[y > 0]
    of_all = x[y > 0][:, :4].sum(1)
    quoted, reported = np.zeros_like(whole), np.zeros_like(whole)
    quoted[:, 2], reported[:, 3] = of_all, of_all
    x = np.concatenate([x, whole, quoted[of_all > 0], reported[of_all > 0]])
    y = np.concatenate([y, np.ones(len(whole)), np.zeros(2 * int((of_all > 0).sum()))])
    model.weights = min((_fit_weights(x, y, share) for share in _SHARES), key=lambda f: f[0])[1]
    return model


def _fit_weights(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, np.ndarray]:
    """Loss and weights, none of a kind of hit below 0."""
    z, prior = _inputs(x, share), np.delete(_PRIOR, 1)
    free = np.ones(len(prior), dtype=bool)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        w = np.where(free, w, 0.0)
        s = z @ w
        value = np.logaddexp(0, s).mean() - (y * s).mean() + 0.5 * _TRUST * ((w - prior) ** 2).sum()
        return float(value), (z.T @ (sigmoid(s) - y) / len(y) + _TRUST * (w - prior)) * free

    while True:
        w = np.where(free, minimise(loss, np.where(free, prior, 0.0)), 0.0)
        below = np.append(w[:-1] < 0, False)
        if not below.any():
            return loss(w)[0], np.insert(w, 1, share)
        free &= ~below


def _near_misses(sample: DataFrame, model: Toxicity) -> DataFrame:
    """label, half and the distinct misspelled hits of each row, lower case."""
    sent = docs_broadcast(sample, model)

    def make(piece: pa.RecordBatch) -> dict:
        trie, name, _ = sent.value
        found = hits(piece.column("text"), Trie.received(trie), name)[1]
        return {"words": pa.array([sorted({w.lower() for _, _, w, k, _ in f if k == 2}) for f in found], pa.list_(pa.string()))}

    return with_columns(sample, "text", "words array<string>", make, ["label", "half"], limit=TEXT_BYTES)


def _too_common(rows: list, model: Toxicity) -> set[str]:
    """Entries that must match exactly, as near misses of theirs are new again and again in clean rows.

    The share of clean rows with a near miss that no row before had is about the share of
    near misses that one clean row has (Good and Turing's estimate). An entry with more than
    RISK of it would make hits of unseen words, whatever words the sample shows to be ordinary.
    """
    clean = [r.words for r in rows if not r.label > 0]
    seen = Counter(w for words in clean for w in words)
    left, exact = [w for w, n in seen.items() if n == 1], set()
    while True:
        trie = Trie(model.terms, model.stems, exact=frozenset(exact))
        entries = [(w, trie.near(w)) for w in left]
        new = Counter(e for _, e in entries if e)
        found = {e for e, n in new.items() if n > max(2, RISK * len(clean))}
        if not found:
            return exact
        exact |= found
        left = [w for w, e in entries if e]


def _ordinary(rows: list, model: Toxicity) -> set[str]:
    """Near misses in rows that are not toxic, unless toxic rows have them LEAST_RATIO times as often."""
    trie = Trie(model.terms, model.stems, exact=frozenset(model.exact))
    seen: dict[str, list[int]] = {}
    size = [0, 0]
    for r in rows:
        size[r.label > 0] += 1
        for w in r.words:
            seen.setdefault(w, [0, 0])[r.label > 0] += 1
    common = (w for w, (clean, toxic) in seen.items() if clean and toxic * size[0] < LEAST_RATIO * clean * size[1])
    return {w for w in common if kind_of(trie, w) == 2}


def docs_broadcast(docs: DataFrame, model: Toxicity):
    """The model for the workers."""
    return docs.sparkSession.sparkContext.broadcast((model.trie().fields(), model.name, model.weights))


def _with_counts(sample: DataFrame, model: Toxicity, by_half: list[set[str]]) -> DataFrame:
    """key, label, counts of hits, and of the text misspelled, each half with its own ordinary words."""
    made = [Toxicity(model.terms, model.stems, model.weights, words, model.exact) for words in by_half]
    sent = sample.sparkSession.sparkContext.broadcast([(m.trie().fields(), m.name) for m in made])

    def make(piece: pa.RecordBatch) -> dict:
        half = piece.column("half").to_numpy()
        counts, changed = np.zeros((len(half), len(COUNTS))), np.zeros((len(half), len(COUNTS)))
        for h, (fields, name) in enumerate(sent.value):
            own, trie = np.flatnonzero(half == h), Trie.received(fields)
            if len(own):
                counts[own], found = hits(piece.column("text").take(pa.array(own)), trie, name)
                changed[own] = _misspelled_counts(counts[own], found, trie)
        kind = pa.list_(pa.float64())
        return {"hits": pa.array(counts.tolist(), kind), "altered": pa.array(changed.tolist(), kind)}

    return with_columns(sample, "text", "hits array<double>, altered array<double>", make, ["key", "label"], limit=TEXT_BYTES, needs=["half"])


_HITS = "array<struct<from:int,to:int,word:string,misspelled:boolean,abuse:double>>"


def score_toxicity(docs: DataFrame, model: Toxicity, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds toxicity (0 to 1), toxic (0.5 or more) and toxic_hits, the hits with their places.

    The score is a function of the text alone. A null or empty text has no hits and gets
    the score of the intercept. Repeated rows get the same result. Input columns with a
    result's name give way to it. One pass, no shuffle.
    """
    sent = docs_broadcast(docs, model)
    kind = pa.list_(
        pa.struct([("from", pa.int32()), ("to", pa.int32()), ("word", pa.string()), ("misspelled", pa.bool_()), ("abuse", pa.float64())])
    )

    def make(piece: pa.RecordBatch) -> dict:
        trie, name, weights = sent.value
        counts, found = hits(piece.column(text), Trie.received(trie), name)
        score = _probability(counts, weights)
        rows = [[{"from": a, "to": b, "word": w, "misspelled": k == 2, "abuse": c} for a, b, w, k, c in f] for f in found]
        return {"toxicity": score, "toxic": score >= 0.5, "toxic_hits": pa.array(rows, kind)}

    result = f"toxicity double, toxic boolean, toxic_hits {_HITS}"
    return with_columns(docs, text, result, make, keep, limit=TEXT_BYTES)


def remove_toxic(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """The rows that are not toxic, with their columns only."""
    sent = docs_broadcast(docs, model)

    def make(piece: pa.RecordBatch) -> dict:
        trie, name, weights = sent.value
        return {"_clean": _probability(hits(piece.column(text), Trie.received(trie), name)[0], weights) < 0.5}

    return with_columns(docs, text, "_clean boolean", make, mask="_clean", limit=TEXT_BYTES)
