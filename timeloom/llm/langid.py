"""Language identification by cross-parsing.

Per language a suffix automaton is built over labelled text. A text is parsed greedily: each phrase is
the longest match of what is left with any substring of the language's text. A phrase costs the
logarithm of that text's length, which is what it takes to say where it stands; the language with the
least cost a character wins, so that languages with less text to learn from aren't at a loss.

Texts are parsed whole. Pieces of SEGMENT characters are parsed in step, each as if a phrase began at its
start; then each piece's parse goes on into the next piece until both have a phrase that begins at one
place, from where on they agree. The phrases counted are those of the one parse of the text.

The fit takes at most DOCS rows a language (those of least hash) and EXCERPT characters of each, cut
to FIT_CHARS in all, and keeps every character of that. The automata that are broadcast have at most
2 * FIT_CHARS states and 3 * FIT_CHARS transitions a language: dense tables over the language's own
characters as long as DENSE_CELLS suffice, sorted transitions for the rest. At most LANGUAGES are
broadcast at once; more are judged in several passes, between which rows are written to the shared
folder. The driver holds the bounded texts of all languages.

Cases: text that is null or has no letter (Unicode category L) gives `und` and score 0; without any
learned language every text does; equal costs go to the language first by code point; very long texts
are parsed whole; repeated rows are judged each for itself; null ids count as any other; an empty table
gives an empty result; further columns are kept, but for an input's own `lang_pred` and `score`, whose
place the new ones take.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held_out, load

DOCS = 64
EXCERPT = 1000
FIT_CHARS = 24_000
LANGUAGES = 256
DENSE_CELLS = 1 << 24
SEGMENT = 512
_LETTER = regex.compile(r"\p{L}")


def suffix_automaton(symbols) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    go, link, size, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(go)
        go.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return go


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Table:
    """The automaton of one language: the next state of (state, symbol), or, where the match ends, the
    state after starting anew with the symbol, as -1 minus it. Symbol 0 is any character that the
    language's text lacks."""

    def __init__(self, symbols: np.ndarray, width: int, dense_cells: int):
        go = suffix_automaton(symbols.tolist())
        self.width, self.cells = width, len(go) * width
        self.start = np.full(width, -1, np.int32)
        for c, to in go[0].items():
            self.start[c] = -to - 1
        self.keys = np.array([s * width + c for s, moves in enumerate(go) for c in sorted(moves)], np.int64)
        self.to = np.array([moves[c] for moves in go for c in sorted(moves)], np.int32)
        self.flat = None
        if self.cells <= dense_cells:
            self.flat = np.tile(self.start, len(go))
            self.flat[self.keys] = self.to
            self.keys = self.to = None

    def move(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return self.flat[state * self.width + symbol]
        key = state.astype(np.int64) * self.width + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], self.start[symbol])


class Model:
    """An automaton a language, over all characters of its text."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        own = {lang: np.unique(_points(texts[lang])) for lang in self.langs}
        self.symbols = np.unique(np.concatenate([np.empty(0, np.uint32), *own.values()]))
        self.weights = np.array([np.log2(len(texts[lang]) + 1) for lang in self.langs])
        self.tables, self.maps, left = [], [], DENSE_CELLS
        for lang in self.langs:
            # From the symbols of all languages, 0 for unknown ones, to those of this one.
            to_own = np.zeros(len(self.symbols) + 1, np.int32)
            to_own[np.searchsorted(self.symbols, own[lang]) + 1] = np.arange(1, len(own[lang]) + 1)
            table = Table(to_own[self.map(texts[lang])], len(own[lang]) + 1, left)
            left -= table.cells if table.flat is not None else 0
            self.tables.append(table)
            self.maps.append(to_own)

    def map(self, text: str) -> np.ndarray:
        points = _points(text)
        if not len(self.symbols):
            return np.zeros(len(points), np.int32)
        at = np.minimum(np.searchsorted(self.symbols, points), len(self.symbols) - 1)
        return np.where(self.symbols[at] == points, at + 1, 0).astype(np.int32)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each language needs for each text: (texts, languages)."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            s = self.map(t)
            for at in range(0, len(s), SEGMENT):
                parts.append(s[at : at + SEGMENT])
                owner.append(i)
        out = np.zeros((len(texts), len(self.langs)))
        if not parts:
            return out
        sizes = np.array([len(p) for p in parts])
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((int(sizes.max()), len(parts)), np.int32)
        for lane, k in enumerate(order.tolist()):
            grid[: sizes[k], lane] = parts[k]
        lane_of = np.empty(len(parts), np.int64)
        lane_of[order] = np.arange(len(parts))
        owner = np.array(owner)
        # The lane of the piece that follows in the same text, or -1.
        following = np.full(len(parts), -1)
        more = np.flatnonzero(owner[1:] == owner[:-1])
        following[lane_of[more]] = lane_of[more + 1]
        sizes, owner = sizes[order], owner[order]
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(owner, weights=self._counted(j, grid, sizes, following), minlength=len(texts))
        return out

    def _counted(self, j: int, grid: np.ndarray, sizes: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Phrases of the whole texts' parses, each counted at the lane whose parse it is part of; 0 at
        lanes whose own parse isn't part of it. Lanes are in order of their sizes, the largest first."""
        table, to_own = self.tables[j], self.maps[j]
        live = np.searchsorted(-sizes, -np.arange(len(grid)), side="left")
        begins = np.zeros(grid.shape, bool)  # a phrase of the lane's own parse begins here
        state = np.zeros(len(sizes), np.int32)
        for step in range(len(grid)):
            n = live[step]
            to = table.move(state[:n], to_own[grid[step, :n]])
            begins[step, :n] = (to < 0) | (state[:n] == 0)
            state[:n] = np.where(to < 0, -to - 1, to)
        # Each lane goes on until it meets the parse of a later one: which, how much of that lies before
        # the meeting, and the phrases until then.
        meets, before, extra = np.full(len(sizes), -1), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        lanes = np.flatnonzero(following >= 0)
        into, at = following[lanes], state[lanes]
        while len(lanes):
            seen = np.zeros(len(lanes), np.int64)
            on = np.arange(len(lanes))
            for step in range(len(grid)):
                on = on[step < sizes[into[on]]]
                if not len(on):
                    break
                to = table.move(at[on], to_own[grid[step, into[on]]])
                new, theirs = (to < 0) | (at[on] == 0), begins[step, into[on]]
                at[on] = np.where(to < 0, -to - 1, to)
                met = new & theirs
                meets[lanes[on[met]]], before[lanes[on[met]]] = into[on[met]], seen[on[met]]
                extra[lanes[on[new & ~met]]] += 1
                seen[on] += theirs
                on = on[~met]
            going = (meets[lanes] < 0) & (following[into] >= 0)
            lanes, into, at = lanes[going], following[into[going]], at[going]
        own = begins.sum(axis=0)
        if (meets != following).any():
            return self._chained(own, extra, meets, before, following)
        counts = own + extra
        counts[meets[meets >= 0]] -= before[meets >= 0]
        return counts

    @staticmethod
    def _chained(own, extra, meets, before, following) -> np.ndarray:
        """The counts along the chain of lanes that each text's parse really takes."""
        counts = np.zeros(len(own), np.int64)
        first = np.ones(len(own), bool)
        first[following[following >= 0]] = False
        for lane in np.flatnonzero(first).tolist():
            skipped = 0
            while lane >= 0:
                counts[lane] = own[lane] - skipped + extra[lane]
                lane, skipped = meets[lane], before[lane]
        return counts


def fit_texts(docs: DataFrame) -> dict[str, str]:
    """docs (doc_id, text, lang): labelled rows to learn from. The bounded text of each language."""
    d = docs.where("lang is not null and text is not null")
    d = d.select("lang", F.lower(F.substring("text", 1, EXCERPT)).alias("text"), F.xxhash64("doc_id").alias("h"), "doc_id")
    w = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    d = d.withColumn("n", F.row_number().over(w)).where(F.col("n") <= DOCS)
    d = d.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("texts"))
    rows = d.select("lang", F.substring(F.array_join("texts.text", "\n"), 1, FIT_CHARS).alias("text")).collect()
    return {r["lang"]: r["text"] for r in rows}


def _refined(docs: DataFrame, model: Model) -> DataFrame:
    """docs (row, text, lang_pred, cost of the best language so far, 0 before any, and rates, the sum of
    the inverse costs), taken on over the languages of model, all later by code point than those before."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = ("lang_pred", "cost", "rates")

    def judged(texts, langs, costs, rates):
        m = shared.value
        known = [i for i, t in enumerate(texts) if m.langs and t and _LETTER.search(t)]
        if known:
            n = m.phrases([texts[i].lower() for i in known]) * m.weights
            best, inverse = n.argmin(axis=1), (1 / n).sum(axis=1)
            for row, i in enumerate(known):
                least = float(n[row, best[row]])
                if not costs[i] or least < costs[i]:
                    langs[i], costs[i] = m.langs[best[row]], least
                rates[i] += float(inverse[row])
        return langs, costs, rates

    def run(batches):
        for batch in batches:
            at = 0
            sizes = [len(t.as_py() or "") for t in batch.column("text")]
            while at < batch.num_rows:
                n, held = 0, 0
                while at + n < batch.num_rows and (n == 0 or held < 4_000_000):
                    held += sizes[at + n]
                    n += 1
                part = batch.slice(at, n)
                found = judged(part.column("text").to_pylist(), *(part.column(c).to_pylist() for c in own))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("text"), pa.array(found[0], pa.string()), *(pa.array(c, pa.float64()) for c in found[1:])],
                    names=["row", "text", *own])
                at += n

    row = docs.schema["row"].dataType.simpleString()
    return docs.mapInArrow(run, f"row {row}, text string, lang_pred string, cost double, rates double")


def _identified(docs: DataFrame, models) -> DataFrame:
    """models: in the order of their languages, each made when its turn comes."""
    names = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    d = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("rates"))
    for k, model in enumerate(models):
        d = _refined(cut(d, "languages") if k else d, model)
    score = F.when(F.col("rates") > 0, 1 / F.col("cost") / F.col("rates")).otherwise(0.0)
    return d.select(*(F.col("row").getField(c).alias(c) for c in names), "lang_pred", score.alias("score"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) to the columns of docs but text, with lang_pred and score. The score is
    the winner's share of the inverse costs."""
    return _identified(docs, [model])


def identify(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """As predict, for any number of languages and their texts."""
    langs = sorted(texts)
    blocks = [langs[at : at + LANGUAGES] for at in range(0, len(langs), LANGUAGES)]
    return _identified(docs, (Model({lang: texts[lang] for lang in block}) for block in blocks))


def op8_cross_parsing(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").cast("string").alias("text"), "lang", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    texts = fit_texts(docs.where("not held_out").select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text", "held_out"), texts)
