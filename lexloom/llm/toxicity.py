"""Toxicity: a lexicon trie intersected with Levenshtein automata, scored in context.

The trie of all terms and the Levenshtein automaton of each term's edit budget
are run as one nondeterministic machine over (trie node, edits spent) and made
deterministic once, on the driver.  A whole slice of words then steps through
the table together, one character a step, so only words that are still within
reach of some term cost anything.

The lexicon.  ``BUILT_IN`` has a few unambiguous insults; ``fit`` adds the terms that
labelled texts show: at most ``per_group`` texts of each language and label, those of
the smallest md5 of their id, are read whole, and a word is a term if the texts of
its language that have it are toxic far more often than by chance (the likelihood
ratio beyond one in a hundred for all words tried at once) and at least RATIO times
as often as clean.  Near copies count as one text, so that the words of a copied
text aren't taken for terms.  Of these, the ``terms`` most significant stay.  Terms are
learned by language and apply to all texts; one that is less than CLEAR times as
frequent in toxic texts weighs half.  Every term bears as many edits as the sample
allows: forms at that distance must be missing in clean texts, or be RATIO times as
frequent in toxic ones.  Without labelled toxic texts the lexicon is the
built-in one.

Budgets: terms of up to 4 letters must match exactly, up to 7 letters allow one
edit, longer ones two; two neighbouring letters that are swapped are one edit, and the
first letter is never edited.  Accents are removed, the usual digit and sign
substitutions (0 1 3 4 5 7 @ $) and Cyrillic look-alikes are read as letters
before matching, at no cost.  Words that are spelled with gaps aren't found.

Each hit weighs 1 (exact), 0.7 (one edit) or 0.3 (two), so a one-edit form
decides when it is addressed or said twice.  Two edits are weak evidence: a
repeated form weighs again only where it is addressed, so that an unusual word
near a term doesn't condemn a long text.  Common words that are an edit or two
from a term (``LOOKALIKES``) are no hits.  Inside quotation marks on one
line, or on a line that starts with ``>``, a hit weighs a fifth; otherwise a
reporting word among the ``window`` words before or after it (of any length) halves it
and a second-person word there multiplies it by 1.5.  A text is toxic when its sum
reaches the threshold.

Defined cases: null or empty text scores 0 and isn't toxic; rows are judged one
by one, so repeated rows and repeated or null ids each give a row; a term found
at equal distance twice counts as the alphabetically first; other columns are
dropped, whatever their names.  Texts of any length are read whole.  In the fit,
labels with a null id or a null label are left out, an id with several labels is
toxic if one says so, texts of a null language are a group of their own, and null or
empty texts add no words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .session import cut, small

#: Unambiguous insults; words that are also used otherwise are left to the fit.
LEXICON = tuple(
    "abruti abschaum arschloch asshole bastard bitch cabron connard cretin debile douchebag drecksau dumbass dummkopf estupido gilipollas "
    "halfwit idiot idiota imbecile jackass maricon moron nitwit pendejo retard salope schlampe scum scumbag trottel vollidiot wichser".split()
)
REPORTING = frozenset("said says say called calls quote quoted word words term slur insult wrote writes reported sagte nannte wort dit appelle mot dijo llamo palabra".split())
ADDRESSING = frozenset("you your youre yourself u du dich dein ihr tu te toi vous ton usted eres".split())
QUOTED = re.compile("\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“\n]*“|^>[^\n]*", re.M)
WORD = re.compile(r"\w+")
SCHEMA = "{id} bigint, hits int, fuzzy_hits int, quoted_hits int, score double, toxic boolean"

#: Common words near a term of everyday abuse.
LOOKALIKES = frozenset(
    "batch birch botch butch carbon crown digesting discussing disguising estupendo idiom laser leser loger loner lose losen loses louer lover lower loyer marion moon moran mormon morn moroni "
    "regard reward schlamm schlange schlanke schlappe slope thrash trotter wordless worthiness".split()
)
#: Labelled texts of each language and label that the fit reads, and terms that it adds.
PER_GROUP, TERMS = 5000, 400
#: How much more frequent terms are in toxic texts, and from what on they decide alone.
RATIO, CLEAR = 20, 100
#: Texts that share one of BANDS triples of least n-gram hashes count as one in the fit.
BANDS = 8

_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "ß": "s", "æ": "a", "ø": "o", "œ": "o", "ł": "l", "đ": "d", "ı": "i"}
_LEET |= dict(zip("авекмнорстухіјѕ", "abekmhopctyxijs"))


def fold(char: str) -> str:
    """The letter a-z that a character counts as, or "" for any other."""
    char = char.lower()
    char = _LEET.get(char, unicodedata.normalize("NFD", char)[:1])
    return char if "a" <= char <= "z" and len(char) == 1 else ""


def budget(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


@dataclass(frozen=True)
class Lexicon:
    """Folded terms with their edits, those that weigh half, and folded words that are no hits."""

    budgets: dict[str, int]
    weak: frozenset[str] = frozenset()
    lookalikes: frozenset[str] = LOOKALIKES

    @classmethod
    def of(cls, terms, lookalikes: frozenset[str] = LOOKALIKES) -> Lexicon:
        return cls({t: budget(t) for t in ("".join(map(fold, t)) for t in terms) if t}, lookalikes=lookalikes)


BUILT_IN = Lexicon.of(LEXICON)


class Automaton:
    """table[state, class] is the next state (0: none); best[state] is (edits, term) or (-1, -1).

    With ``swaps``, two neighbouring letters that changed places are one edit: the
    cell -(27 * node + letter) waits for the letter that leads to the node.
    """

    def __init__(self, lexicon: Lexicon, swaps: bool = False):
        self.terms, budgets = sorted(lexicon.budgets), lexicon.budgets
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        room = [0]
        for k, term in enumerate(self.terms):
            node = 0
            for char in term:
                room[node] = max(room[node], budgets[term])
                c = ord(char) - 96
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    room.append(0)
                node = children[node][c]
            room[node] = max(room[node], budgets[term])
            ends[node] = k

        def closed(cells: dict[int, int]) -> frozenset:
            todo = list(cells.items())
            while todo:
                node, e = todo.pop()
                if node > 0:
                    for child in children[node].values():
                        if e + 1 <= room[child] and cells.get(child, 9) > e + 1:
                            cells[child] = e + 1
                            todo.append((child, e + 1))
            return frozenset(cells.items())

        start = closed({0: 0})
        number, states, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
        for state in states:
            row = []
            for c in range(27):
                out: dict[int, int] = {}
                for node, e in state:
                    if node < 0:
                        if -node % 27 == c and out.get(-node // 27, 9) > e:
                            out[-node // 27] = e
                        continue
                    if swaps and node:
                        for letter, child in children[node].items():
                            last = children[child].get(c)
                            if last and letter != c and e + 1 <= room[last]:
                                wait = -(27 * last + letter)
                                out[wait] = min(out.get(wait, 9), e + 1)
                    for letter, child in children[node].items():
                        cost = e + (letter != c)
                        if (cost == e or node) and cost <= room[child] and out.get(child, 9) > cost:
                            out[child] = cost
                    if node and e + 1 <= room[node] and out.get(node, 9) > e + 1:
                        out[node] = e + 1
                to = closed(out)
                if to not in number:
                    number[to] = len(states)
                    states.append(to)
                row.append(number[to])
            rows.append(row)
        self.table = np.array(rows, dtype=np.int32)
        self.best = np.full((len(states), 2), -1, dtype=np.int16)
        for i, state in enumerate(states):
            found = min(((e, ends[n]) for n, e in state if n in ends and e <= budgets[self.terms[ends[n]]]), default=None)
            if found:
                self.best[i] = found
        self.longest = max(map(len, self.terms), default=0) + 2
        self.shortest = min(map(len, self.terms), default=1) - 2


_FOLDED = 0x460
#: Stands for a letter or digit that isn't folded.
_OTHER = "\u4e00"
_CLASS = np.array([ord(fold(chr(i)) or "`") - 96 for i in range(_FOLDED)] + [0], dtype=np.int8)
_IN_WORD = np.array([chr(i).isalnum() or chr(i) in "@$" for i in range(_FOLDED)] + [True])


def _words(column: pa.Array) -> tuple[np.ndarray, ...]:
    """The class of each character, starts and ends of the words, and each text's offset."""
    points, offs = tk.code_points(tk.lowered(column))
    near = np.minimum(points, _FOLDED)
    inside = np.zeros(len(points) + 1, dtype=np.int8)
    inside[1:] = _IN_WORD[near]
    edge = np.diff(inside)
    return _CLASS[near], np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), offs


def find(column: pa.Array, machine: Automaton) -> tuple[np.ndarray, ...]:
    """Rows, start and end (in characters of the text), edits and terms of all hits."""
    classes, starts, ends, offs = _words(column)
    length = ends - starts
    at = np.flatnonzero((length >= machine.shortest) & (length <= machine.longest) & (machine.table[1][classes[starts]] > 0)) if len(starts) else starts
    state, step, found = np.ones(len(at), dtype=np.int32), 0, []
    while len(at):
        state = machine.table[state, classes[starts[at] + step]]
        step += 1
        live = state > 0
        at, state = at[live], state[live]
        over = length[at] == step
        hit = over & (machine.best[state, 0] >= 0)
        if hit.any():
            found.append(np.column_stack((at[hit], machine.best[state[hit]])))
        at, state = at[~over], state[~over]
    hits = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    hits = hits[np.argsort(hits[:, 0], kind="stable")]
    row = np.searchsorted(offs, starts[hits[:, 0]], side="right") - 1
    return row, starts[hits[:, 0]] - offs[row], ends[hits[:, 0]] - offs[row], hits[:, 1], hits[:, 2]


def judge(text: str, hits: list[tuple[int, int, int, float]], window: int, threshold: float, lookalikes: frozenset[str] = LOOKALIKES) -> tuple[int, int, int, float, bool]:
    """hits: (start, end, edits, share of the weight) in order."""
    spans = [m.span() for m in QUOTED.finditer(text)]
    hits = [h for h in hits if not h[2] or "".join(map(fold, text[h[0] : h[1]])) not in lookalikes]
    words = [m.span() for m in WORD.finditer(text)] if hits else []
    score, quoted, fuzzy, k, seen = 0.0, 0, 0, 0, set()
    for a, b, edits, share in hits:
        weight = (1.0, 0.7, 0.3)[edits] * share
        fuzzy += edits > 0
        word = text[a:b].lower()
        again = edits > 1 and word in seen
        seen.add(word)
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k < len(spans) and spans[k][0] <= a and b <= spans[k][1]:
            quoted += 1
            weight *= 0.0 if again else 0.2
        else:
            first, last = bisect_left(words, (a, 0)), bisect_left(words, (b, 0))
            around = words[max(0, first - window) : first] + words[last : last + window]
            near = {text[x:y].lower() for x, y in around}
            addressed = bool(near & ADDRESSING)
            weight *= (0.5 if near & REPORTING else 1.0) * (1.5 if addressed else 0.0 if again else 1.0)
        score += weight
    return len(hits), fuzzy, quoted, round(score, 6), score >= threshold - 1e-9


def _sampled(docs: DataFrame, labels: DataFrame, per_group: int) -> DataFrame:
    """lang, toxic, text_key, words (folded, different) and bands of the labelled texts that are read."""
    known = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = Window.partitionBy("lang", "toxic").orderBy(F.md5(F.col("id").cast("string")), "id")
    named = docs.select("id", "lang").join(known, "id")
    chosen = cut(named.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_group).select("id", "toxic").distinct())
    texts = docs.join(small(chosen, chosen.count(), 24), "id").select("lang", "toxic", F.xxhash64("text").alias("text_key"), "text")
    seeds = [np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k in range(1, 3 * BANDS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                column = part.column(3)
                classes, starts, ends, offs = _words(column)
                letters = (classes + 96).astype(np.uint8).tobytes().decode("ascii")
                first = np.searchsorted(starts, offs).tolist()
                a, b = starts.tolist(), ends.tolist()
                grams, at = tk.Words(column).grams(3)
                words, bands = [], []
                for k in range(part.num_rows):
                    mine = {letters[a[i] : b[i]] for i in range(first[k], first[k + 1])}
                    words.append([w.replace("`", _OTHER) for w in mine if len(w) > 2])
                    own = grams[at[k] : at[k + 1]]
                    least = np.array([tk.mix(own ^ s).min() for s in seeds], dtype=np.uint64).reshape(BANDS, 3) if len(own) else np.zeros((0, 3), np.uint64)
                    bands.append(tk.mix(least[:, 0] + tk.mix(least[:, 1] + tk.mix(least[:, 2] + np.arange(len(least), dtype=np.uint64)))).view(np.int64).tolist())
                cols = [*(part.column(i) for i in range(3)), pa.array(words, pa.list_(pa.string())), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "toxic", "text_key", "words", "bands"])

    return cut(texts.mapInArrow(tk.tidy(run), "lang string, toxic int, text_key bigint, words array<string>, bands array<bigint>"))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", per_group: int = PER_GROUP, terms: int = TERMS, built_in: Lexicon = BUILT_IN) -> Lexicon:
    """``built_in`` with the terms that ``labels`` (``id_col`` and ``label_col``: above 0 is toxic) show in the texts of ``df`` (see the module's text)."""
    docs = df.select(df[id_col].cast("bigint").alias("id"), df[lang_col].cast("string").alias("lang"), df[text_col].cast("string").alias("text"))
    marked = labels.select(labels[id_col].cast("bigint").alias("id"), (labels[label_col].cast("double") > 0).cast("int").alias("toxic"))
    sample = _sampled(docs, marked, per_group)
    groups = ["lang", "toxic"]
    # a text's cluster: the least key among the texts that share a band with it, by language and label
    banded = sample.select(*groups, "text_key", F.explode("bands").alias("band")).distinct()
    lang = F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n")).alias("lang")
    least = banded.groupBy(*groups, "band").agg(F.min("text_key").alias("least"))
    keyed = banded.select(lang, "toxic", "band", "text_key").join(least.select(lang, "toxic", "band", "least"), ["lang", "toxic", "band"])
    clusters = keyed.groupBy("lang", "toxic", "text_key").agg(F.min("least").alias("cluster"))
    texts = cut(sample.select(lang, "toxic", "text_key", "words").join(clusters, ["lang", "toxic", "text_key"]).select("lang", "toxic", "cluster", "words"))
    sizes = texts.select("lang", "toxic", "cluster").distinct().groupBy("lang").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
    words = texts.select("lang", "toxic", "cluster", F.explode("words").alias("word")).distinct()
    words = cut(words.groupBy("lang", "word").agg(F.sum("toxic").alias("k1"), F.sum(1 - F.col("toxic")).alias("k0")))
    tried = words.groupBy("lang").agg(F.count(F.lit(1)).alias("tried"))
    counts = {r["lang"]: r for r in sizes.join(tried, "lang").collect()}  # a row a language
    n1, n0 = (sum(r[c] for r in counts.values()) for c in ("n1", "n0"))
    rows = [(k, r["n1"], r["n0"], math.log(100 * r["tried"])) for k, r in counts.items() if r["n1"] and r["n0"]]
    if not rows:
        return built_in
    share = words.sparkSession.createDataFrame(rows, "lang string, n1 bigint, n0 bigint, needed double")
    k1, k0 = (F.col(c).cast("double") for c in ("k1", "k0"))
    both, expected = k1 + k0, F.col("n1") / (F.col("n1") + F.col("n0"))
    gain = k1 * F.log(k1 / both / expected) + F.when(k0 > 0, k0 * F.log(k0 / both / (1 - expected))).otherwise(0.0)
    often = words.where((F.col("k1") >= 3) & ~F.col("word").contains(_OTHER)).join(F.broadcast(share), "lang").where(k1 * F.col("n0") >= RATIO * k0 * F.col("n1")).withColumn("gain", gain).where("gain >= needed")
    rare = F.col("k1") * F.col("n0") >= CLEAR * F.col("k0") * F.col("n1")
    best = often.groupBy("word").agg(F.max("gain").alias("gain"), F.min(rare).alias("clear")).orderBy(F.desc("gain"), "word").limit(terms)
    learned = {r["word"]: r["clear"] for r in best.collect()}  # at most ``terms``
    weak = frozenset(w for w, clear in learned.items() if not clear and w not in built_in.budgets) | built_in.weak
    budgets = Lexicon.of(learned).budgets | built_in.budgets
    machine = Automaton(Lexicon(budgets), swaps=True)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _, _, edits, found = find(batch.column(0), machine)
            far = edits > 0
            at = pa.array(at[far])
            term = pa.array(np.array(machine.terms, dtype=object)[found[far]], pa.string())
            yield pa.RecordBatch.from_arrays([term, pa.array(edits[far].astype(np.int32)), batch.column(1).take(at), batch.column(2).take(at)], names=["term", "edits", "k1", "k0"])

    seen = words.select("word", "k1", "k0").mapInArrow(tk.tidy(forms), "term string, edits int, k1 bigint, k0 bigint")
    for r in seen.groupBy("term", "edits").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0")).collect():  # two rows a term at most
        if r["k0"] and r["k1"] * n0 < RATIO * r["k0"] * n1:
            budgets[r["term"]] = min(budgets[r["term"]], r["edits"] - 1)
    return Lexicon(budgets, weak, built_in.lookalikes)


def toxicity(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: Lexicon = BUILT_IN, window: int = 6, threshold: float = 1.0) -> DataFrame:
    """One row for each text: hits, fuzzy_hits, quoted_hits, score and toxic (see the module's text)."""
    schema = SCHEMA.format(id=f"`{id_col}`")
    return _scan(df.select(df[id_col].cast("bigint"), df[text_col].cast("string")), schema, lexicon, window, threshold, False)


def clean(df: DataFrame, text_col: str = "text", lexicon: Lexicon = BUILT_IN, window: int = 6, threshold: float = 1.0) -> DataFrame:
    """The rows of ``df``, all columns, whose text isn't toxic; read once, without a join."""
    return _scan(df, df.schema, lexicon, window, threshold, True, text_col)


def _scan(df, schema, lexicon, window, threshold, keep, text_col=None):
    machine = Automaton(lexicon, swaps=True)
    shares = np.array([0.5 if t in lexicon.weak else 1.0 for t in machine.terms])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = text_col or batch.schema.names[1]
            for part in tk.slices(batch, name):
                column = tk.column(part, name)
                rows, a, b, edits, terms = find(column, machine)
                n = part.num_rows
                out = {}
                for row in np.unique(rows).tolist():
                    i, j = np.searchsorted(rows, [row, row + 1])
                    out[row] = judge(column[row].as_py(), list(zip(a[i:j].tolist(), b[i:j].tolist(), edits[i:j].tolist(), shares[terms[i:j]].tolist())), window, threshold, lexicon.lookalikes)
                if keep:
                    toxic = {r for r, x in out.items() if x[4]}
                    yield part.filter(pa.array([r not in toxic for r in range(n)])) if toxic else part
                else:
                    none = (0, 0, 0, 0.0, False)
                    cols = list(zip(*(out.get(r, none) for r in range(n))))
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())))], names=[batch.schema.names[0], "hits", "fuzzy_hits", "quoted_hits", "score", "toxic"])

    return df.mapInArrow(tk.tidy(run), schema)
