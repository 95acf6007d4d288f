"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer turns words into classes and insult weights; transducers for negation, reported
speech, targets and threats read the classes and are composed to one machine that scores a clause.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, steps, word_bounds

#: Rows of ``labels`` that are learned from at most; a hash of doc_id picks them when there are more.
SAMPLE = 16_000
#: Learned patterns kept at most (those with the best bounds; a size of the model, learned from the bounded sample), least rows of a pattern, prefix lengths in characters.
PATTERNS, SUPPORT, PREFIXES = 4000, 3, (4, 5, 6, 7, 8)
#: Score from which a document counts as toxic.
THRESHOLD = 0.7

# Starting lexicons of the lexical transducer (English, German, Spanish, French).
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown dumbass imbecile dummkopf vollidiot abschaum arschloch estúpido imbécil escoria basura crétin connard ordure débile".split()
WORDS = {
    "threat": "kill hurt destroy beat smash shoot burn kills hurts töten töte vernichten vernichte schlagen schlage matar mato destruir golpear tuer tue détruire frapper",
    "done": "killed destroyed beaten smashed shot burned burnt getötet vernichtet geschlagen matado destruido golpeado tué détruit frappé",
    "agent": "i we ich wir yo nosotros je nous",
    "second": "you your u ur yours du ihr dein deine tú tu usted ustedes toi vous ton",
    "third": "he she they er ellos ellas él ella ils elle elles",
    "object2": "dich dir euch te os",
    "object3": "him her them ihn ihm ihnen eux lui leur",
    "modal": "will shall should must going gonna werde werden wirst werdet soll sollst voy vamos vas serás deben debes vais va allons seras dois",
    "be": "be get been are is sein sei ser es être est",
    "negation": "not never no isn't aren't don't won't nicht nie kein keine nunca jamás ne pas jamais",
    "contrast": "but aber sondern pero sino mais",
    "break": "and or for with because und oder für mit weil y o para con porque et ou pour avec parce",
    "report": "said says say told wrote called quoted sagte sagt schrieb nannte dijo dice escribió llamó dit écrit appelé",
    "quote": "\" “ ” „ « »",
}
#: Words that stand for two classes.
CONTRACTED = {"you're": ("second", "be"), "you'll": ("second", "modal"), "i'm": ("agent", "be"), "i'll": ("agent", "modal"), "we'll": ("agent", "modal"), "they're": ("third", "be"), "he's": ("third", "be"), "she's": ("third", "be")}

CLASSES = ("other", "insult", *WORDS)
_TALLIED = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"""[^\W_]+(?:['’][^\W_]+)*|["“”„«»]""")
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 59, 63]] = True
FEATURES = 5


@dataclass
class Lexicon:
    """Weights of insult patterns: whole words, and prefixes as arcs of a trie."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.5, 1.0, 1.0, 0.5, 0.5]))
    _written: dict = field(default_factory=dict, repr=False)

    def weight(self, word: str) -> float:
        """The heaviest path that accepts the word; 0 if none does."""
        best = self.words.get(word, 0.0)
        for n in PREFIXES:
            if n > len(word):
                break
            best = max(best, self.prefixes.get(word[:n], 0.0))
        return best

    def symbols(self, word: str) -> tuple[tuple[int, float], ...]:
        """What the lexical transducer writes for a word: its function classes, and an insult with its weight."""
        if word not in self._written:
            found = [(k, 0.0) for k in _CLASS_OF.get(word, ())]
            weight = self.weight(word)
            if weight:
                found.append((_INSULT, weight))
            if len(self._written) >= KNOWN_WORDS:
                self._written.clear()
            self._written[word] = tuple(found) or _OTHER
        return self._written[word]

    def heads(self) -> np.ndarray:
        """Three-byte heads of all patterns and verbs of harm, as a table: most words stop at it."""
        table = np.zeros(1 << 24, bool)
        for x in (*self.words, *self.prefixes, *_HARM):
            b = (x.encode() + b" ")[:3].ljust(3, b" ")
            table[b[0] << 16 | b[1] << 8 | b[2]] = True
        return table


#: Words whose classes a worker remembers at most.
KNOWN_WORDS = 50_000
_INSULT, _OTHER = CLASSES.index("insult"), ((0, 0.0),)
_CLASS_OF: dict[str, tuple[int, ...]] = {w: (CLASSES.index(k),) for k, ws in WORDS.items() for w in ws.split()} | {w: tuple(CLASSES.index(k) for k in ks) for w, ks in CONTRACTED.items()}
_HARM = frozenset((WORDS["threat"] + " " + WORDS["done"]).split())


class Transducer:
    """A deterministic weighted transducer over word classes.

    An arc (state, class) has a next state, a factor on whatever the composed machine writes there, and a
    weight that it writes itself. Classes without an arc take the state's ``*`` arc, else stay.
    """

    def __init__(self, start: str, arcs: dict[tuple[str, str], tuple]):
        self.start, self.arcs = start, arcs

    def step(self, state: str, symbol: str) -> tuple[str, float, float]:
        to, *rest = self.arcs.get((state, symbol), self.arcs.get((state, "*"), (state,)))
        return to, *rest, *(1.0, 0.0)[len(rest) :]


def negation(scope: int = 4, factor: float = 0.1) -> Transducer:
    """What follows a negation within ``scope`` words is damped; a contrast ends the scope."""
    arcs: dict[tuple[str, str], tuple] = {("0", "negation"): (str(scope),)}
    for n in range(1, scope + 1):
        arcs[str(n), "*"] = (str(n - 1), factor)
        arcs[str(n), "negation"], arcs[str(n), "contrast"] = (str(scope), factor), ("0",)
    return Transducer("0", arcs)


def reported(factor: float = 0.6) -> Transducer:
    """What stands in quotation marks or after a verb of saying is damped, unless the writer says it of themselves."""
    arcs = {
        ("direct", "quote"): ("quoted",), ("direct", "report"): ("indirect",), ("direct", "agent"): ("own",),
        ("own", "*"): ("direct",), ("own", "quote"): ("quoted",), ("own", "agent"): ("own",), ("own", "report"): ("direct",), ("own", "modal"): ("own",),
        ("indirect", "*"): ("indirect", factor), ("indirect", "quote"): ("quoted",),
        ("quoted", "*"): ("quoted", factor), ("quoted", "quote"): ("direct",),
    }
    return Transducer("direct", arcs)


def target(factor: float = 1.25, late: float = 0.75) -> Transducer:
    """Insults after a person are raised; a person up to two words after an insult that had none adds ``late``."""
    persons = ("second", "third", "object2", "object3")
    arcs: dict[tuple[str, str], tuple] = {("aimed", "*"): ("aimed", factor), ("none", "insult"): ("late2",)}
    for state, rest in (("late2", "late1"), ("late1", "none")):
        arcs[state, "*"], arcs[state, "insult"] = (rest,), ("late2",)
        arcs |= {(state, p): ("aimed", 1.0, late) for p in persons}
    arcs |= {("none", p): ("aimed", factor) for p in persons}
    return Transducer("none", arcs)


def threat(weight: float = 3.0, reach: int = 3) -> Transducer:
    """Agent, verb of harm and victim in one of their orders.

    A verb needs its victim within ``reach`` words after it, without a conjunction or preposition between, or as an
    object pronoun before it (ich werde dich töten), or as the subject of a passive (you will be killed). Of
    third persons' deeds only those against the reader count in full.
    """
    arcs: dict[tuple[str, str], tuple] = {}
    victims = {"bare": (weight, weight - 0.5), "agent": (weight, weight), "told": (weight, weight / 3)}
    entry = {"agent": ("by",), "second": ("you",), "third": ("by3",), "object2": (f"object{reach}",), "threat": (f"bare{reach}",)}
    of = lambda **more: {**entry, **more}
    states = {"0": of(), "by": of(threat=(f"agent{reach}",), modal=("by",), be=("by",), negation=("by",), other=("0",)), "by3": of(threat=(f"told{reach}",), modal=("by3",), negation=("by3",), other=("0",))}
    states["you"] = of(threat=(f"told{reach}",), modal=("passive2",), be=("you",), negation=("you",))
    for n in (2, 1):
        states[f"passive{n}"] = of(be=("be",), done=("0", 1.0, weight), threat=(f"told{reach}",), negation=(f"passive{n}",), other=(f"passive{n - 1}" if n > 1 else "0",))
    states["be"] = of(be=("be",), done=("0", 1.0, weight), threat=("0", 1.0, weight), negation=("be",))
    for n in range(1, reach + 1):
        states[f"object{n}"] = of(threat=("0", 1.0, weight), **dict.fromkeys(("other", "modal", "agent", "negation", "be"), (f"object{n - 1}" if n > 1 else "0",)))
        for kind, (you, them) in victims.items():
            onward = (f"{kind}{n - 1}" if n > 1 else "0",)
            states[f"{kind}{n}"] = of(second=("you", 1.0, you), object2=("0", 1.0, you), object3=("0", 1.0, them), **dict.fromkeys(("other", "insult", "be", "negation"), onward))
    for state, own in states.items():
        arcs[state, "*"] = ("0",)
        arcs |= {(state, k): a for k, a in own.items()}
    for state in ("0", "by", "by3", "you"):  # an insult is no end of a phrase
        arcs[state, "insult"] = (state,)
    return Transducer("0", arcs)


def composed(*machines: Transducer) -> tuple[list, int]:
    """The product machine over its reachable states: rows of (next, factor, weight) by class, and the start.

    All machines read the same class; factors multiply and scale what any of them writes.
    """
    start = tuple(m.start for m in machines)
    number, rows, queue = {start: 0}, [], [start]
    while queue:
        state, row = queue.pop(0), []
        for symbol in CLASSES:
            moves = [m.step(s, symbol) for m, s in zip(machines, state, strict=True)]
            to = tuple(m[0] for m in moves)
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            factor = math.prod(m[1] for m in moves)
            row.append((number[to], factor, factor * sum(m[2] for m in moves)))
        rows.append(row)
    return rows, 0


GRAMMAR, _START = composed(negation(), reported(), target(), threat())


def clause_score(clause: str, lexicon: Lexicon) -> float:
    """Weight that the composed transducers write for a clause, in one pass over its words."""
    state, total = _START, 0.0
    for word in _TOKEN.findall(clause):
        for symbol, weight in lexicon.symbols(word.replace("’", "'")):
            state, factor, written = GRAMMAR[state][symbol]
            total += factor * weight + written
    return total


_known: dict[int, bool] = {}


def separated(data: np.ndarray) -> np.ndarray:
    """The UTF-8 bytes with blanks for all code points above 127 that are neither letters nor digits, as ``_tally`` splits."""
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return data
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    code = data[lead].astype(np.int64) & (0x7F >> size)
    for i in range(1, 4):
        more = size > i
        code[more] = code[more] << 6 | data[lead[more] + i] & 0x3F
    kinds, which = np.unique(code, return_inverse=True)
    for k in kinds.tolist():
        if k not in _known:
            _known[k] = chr(k).isalnum()
    out = ~np.array([_known[k] for k in kinds.tolist()])[which]
    lead, size, data = lead[out], size[out], data.copy()
    for i in range(4):
        data[lead[size > i] + i] = 32
    return data


def features(column: pa.Array, lexicon: Lexicon, heads: np.ndarray) -> np.ndarray:
    """Per row: log sums of clause scores, matched clauses, best clause, scores per 100 words and distinct matches."""
    data, offsets = flat(pc.utf8_lower(column.cast(pa.large_string())))
    out = np.zeros((len(offsets) - 1, FEATURES))
    if not len(data):
        return out
    raw = data.tobytes()
    data = separated(data)
    starts, ends, rows = word_bounds(data, offsets, ~_WORD)
    words = np.bincount(rows, minlength=len(out))
    padded = np.r_[data, np.full(2, 32, np.uint8)].astype(np.int64)
    second = np.where(ends - starts > 1, padded[starts + 1], 32)
    third = np.where(ends - starts > 2, padded[np.minimum(starts + 2, len(data) - 1)], 32)
    hit = np.flatnonzero(heads[padded[starts] << 16 | second << 8 | third])
    marks = np.flatnonzero(_ENDS[data])
    found: dict[int, list] = {}
    for k in hit:
        word = raw[starts[k] : ends[k]].decode(errors="replace")
        if lexicon.weight(word) or word in _HARM:
            found.setdefault(int(rows[k]), []).append((int(starts[k]), word))
    for row, hits in found.items():
        seen: dict[tuple[int, int], float] = {}
        kinds = set()
        for at, word in hits:
            i = np.searchsorted(marks, at)
            # A clause without a mark is the whole text; it is read once, and every hit in it counts once.
            begin = max(int(offsets[row]), int(marks[i - 1]) + 1 if i else 0)
            end = min(int(offsets[row + 1]), int(marks[i]) if i < len(marks) else len(data))
            if (begin, end) not in seen:
                seen[begin, end] = clause_score(raw[begin:end].decode(errors="replace"), lexicon)
            if seen[begin, end]:
                kinds.add(word)
        matched = [x for x in seen.values() if x]
        if matched:
            total = sum(matched)
            out[row] = [np.log1p(total), np.log1p(len(matched)), np.log1p(max(matched)), np.log1p(100 * total / max(words[row], 1)), np.log1p(len(kinds))]
    return out


def logistic(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 0.3) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards ``prior``."""
    a, w = np.c_[np.ones(len(x)), x], prior.copy()
    for _ in range(50):
        p = logistic(x, w)
        grad = a.T @ (p - y) + strength * (w - prior)
        hess = (a * (p * (1 - p))[:, None]).T @ a + strength * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (pattern, toxic rows, other rows), summed per task."""
    yes: Counter = Counter()
    no: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen = {""}
            for w in set(_TALLIED.findall((text or "").lower())):
                seen.add("=" + w)
                seen.update(w[:n] for n in PREFIXES if n <= len(w))
            (yes if toxic else no).update(seen)
    keys = list(yes.keys() | no.keys())
    for i in range(0, len(keys), 100_000):
        part = keys[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([yes[k] for k in part], pa.int64()), pa.array([no[k] for k in part], pa.int64())], names=["pattern", "yes", "no"])


def _measure(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = lexicon.heads()
        for batch in batches:
            for part in steps(batch):
                x = features(part.column(0), lexicon, heads)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column(1)], names=["x", "toxic"])

    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Lexicon and weights from the rows of ``labels`` whose crc32(doc_id as text) mod 3 is not 1.

    Of those, rows with remainder 0 give the patterns (words and prefixes whose lower bound of the
    log odds of toxic against other rows is high) and rows with remainder 2 the logistic weights of
    the clause features. At most ``sample`` labels are used, chosen by a hash. Null labels, texts
    and ids are left out.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    ids = ids.withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3).filter("fold <> 1").groupBy("doc_id", "fold").agg(F.max("toxic").alias("toxic"))
    n = ids.count()
    if n > sample:
        ids = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(ids), "doc_id")
    counts = rows.filter("fold = 0").select("text", "toxic").mapInArrow(_tally, "pattern string, yes long, no long")
    counts = counts.groupBy("pattern").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    # The empty pattern stands for all rows; the others are ranked by their log odds less twice the standard error.
    rate = (F.col("yes") + 0.5) / (F.col("no") + 0.5)
    error = F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    best = counts.filter((F.col("yes") >= SUPPORT) & (F.col("yes") * 2 > F.col("no")) | (F.col("pattern") == "")).withColumn("bound", F.log(rate) - 2 * error)
    found = {r.pattern: r for r in best.orderBy(F.col("pattern") != "", F.desc("bound"), "pattern").limit(PATTERNS + 1).collect()}
    total = found.pop("", None)
    lexicon = Lexicon(words=dict.fromkeys(INSULTS, 3.0))
    base = np.log((total.yes + 0.5) / (total.no + 0.5)) if total else 0.0
    for r in found.values():
        weight = r.bound - base
        if weight > 1:
            (lexicon.words if r.pattern[0] == "=" else lexicon.prefixes)[r.pattern.lstrip("=")] = float(min(weight, 6.0))
    measured = rows.filter("fold = 2").select("text", "toxic").mapInArrow(_measure(lexicon), "x array<double>, toxic int").toPandas()
    if len(measured):
        lexicon.weights = fit(np.array(measured["x"].tolist()), (measured["toxic"] > 0).to_numpy(float), lexicon.weights)
    return lexicon


def _score(lexicon: Lexicon, names: list[str], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = lexicon.heads()
        for batch in batches:
            for part in steps(batch.rename_columns(names), names[text_at]):
                scores = logistic(features(part.column(text_at), lexicon, heads), lexicon.weights)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*names, "score"])

    return run


def with_score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows with a column ``score`` put last (columns of any name may stand before); a map without shuffle."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    text_at = docs.columns.index("text")
    plain = docs.toDF(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(_score(lexicon, names, text_at), f"{schema}, score double").toDF(*docs.columns, "score")


def toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, score, predicted, one row per input row.

    The score is the probability that the text is toxic; null, empty and wordless texts get that of
    a text without any match. Only the text is read for it. A null doc_id is kept, held_out false.
    """
    scored = with_score(docs.select("doc_id", F.col("text").cast("string").alias("text")), lexicon)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores under the threshold, with their columns."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    scored = with_score(docs, lexicon).toDF(*names, "s")
    return scored.filter(F.col("s") < threshold).drop("s").toDF(*docs.columns)
