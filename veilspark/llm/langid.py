"""Language identification by cross-parsing.

A suffix automaton of sample text stands for each language. A document is parsed greedily
into the longest phrases that occur in the sample; the language that needs the fewest
phrases for each character wins (cross-parsing estimates the cross entropy).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

UNDETERMINED = "und"
#: A text is parsed in stretches of so many characters, all stretches of a batch side by side; phrases run on across them.
STRETCH = 1024
#: Learned from each language: passages (in expectation, from everywhere in its labelled texts) of so many characters at most.
PASSAGES, PASSAGE_CHARS = 32, 2000
#: A text of LEAST symbols or more that needs WORST times as many phrases as unseen text of its best language is in none of the languages.
LEAST, WORST = 64, 2.25
#: Bytes of texts, and symbols of all languages of a group, that are parsed at once: some 20 bytes of memory a symbol of text, 3 a symbol of the group.
SLICE_BYTES, GROUP_SYMBOLS = 2_000_000, 8_000_000
SPACE = 0
#: A state without transitions.
DEAD = 0


@dataclass
class CrossParser:
    """Automata of all languages in one table of transitions.

    A state is the place from which its transitions lie in `goto`, each symbol as far on: the
    entry there holds the state (upper half), if it is this state's, and the next state (lower half).
    """

    langs: list[str]
    alphabet: str
    goto: np.ndarray
    first: np.ndarray  # language x symbol: the state after a phrase's first symbol
    usual: np.ndarray  # phrases for each symbol in unseen text of the language

    @property
    def width(self) -> int:
        return len(self.alphabet) + 2

    def classes(self) -> np.ndarray:
        """Symbol of each code point: 0 unless a letter, 1.. for the alphabet, width - 1 for other letters."""
        table = np.zeros(0x110000, np.int32)
        letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        table[letters] = self.width - 1
        for i, c in enumerate(self.alphabet, 1):
            table[ord(c)] = i
        return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of the lower-cased text; each stretch of other characters is one space."""
    codes = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    return codes[(codes != SPACE) | np.concatenate([[True], codes[:-1] != SPACE])] if len(codes) else codes


def _automaton(sequence: list[int]) -> list[dict[int, int]]:
    nexts, link, size, last = [{}], [-1], [0], 0
    for c in sequence:
        new, p = len(nexts), last
        nexts.append({})
        size.append(size[last] + 1)
        link.append(0)
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return nexts


def placed(state: np.ndarray, symbol: np.ndarray, states: int, width: int, seed: int = 3) -> np.ndarray:
    """A place for each state such that no two transitions, each its symbol on from its state's place, meet and no two states share a place.

    States with many transitions come first. Each round all open states of a batch try a random place;
    of those that claim an entry together the first stays.
    """
    rng = np.random.default_rng(seed)
    degree = np.bincount(state, minlength=states)
    room = 2 * len(state) + 2 * states + 64
    used, taken = np.zeros(room + width + 1, bool), np.zeros(room + 1, bool)
    place = np.zeros(states, np.int64)
    starts = np.cumsum(degree) - degree
    by_degree = np.argsort(-degree, kind="stable")
    taken[DEAD] = True
    lo = 0
    while lo < states:
        d = max(1, int(degree[by_degree[lo]]))
        hi = lo + int(np.searchsorted(-degree[by_degree[lo:]], -(d // 2), "left")) if d > 1 else states
        todo = by_degree[lo : max(hi, lo + 1)]
        while len(todo):
            tried = rng.integers(1, room, len(todo))
            mine = np.repeat(np.arange(len(todo)), degree[todo])
            of = np.repeat(starts[todo] - (np.cumsum(degree[todo]) - degree[todo]), degree[todo]) + np.arange(len(mine))
            at = tried[mine] + symbol[of]
            bad = taken[tried]
            bad[mine[used[at]]] = True
            for claims, who in ((tried, np.arange(len(todo))), (at, mine)):  # of equal claims the first stays
                open_ = ~bad[who]
                _, first = np.unique(claims[open_], return_index=True)
                lost = np.ones(int(open_.sum()), bool)
                lost[first] = False
                bad[who[open_][lost]] = True
            good = ~bad
            place[todo[good]] = tried[good]
            taken[tried[good]] = True
            used[at[good[mine]]] = True
            todo = todo[bad]
        lo = max(hi, lo + 1)
    return place


def train(samples: dict[str, list[str]]) -> CrossParser:
    """Automata of each language's passages; every fourth is first left out to see how unseen text parses."""
    langs = sorted(samples)
    alphabet = "".join(sorted({c for texts in samples.values() for x in texts for c in x.lower() if c.isalpha()}))
    table = CrossParser(langs, alphabet, np.empty(0), np.empty(0), np.empty(0)).classes()
    usual = np.ones(len(langs))
    for i, lang in enumerate(langs):
        known, unseen = [x for j, x in enumerate(samples[lang]) if j % 4], samples[lang][::4]
        if known:
            n, lengths, _ = phrases(_built(alphabet, {lang: known}, table), table, unseen)
            usual[i] = n.sum() / max(1, lengths.sum())
    parser = _built(alphabet, samples, table)
    parser.usual = usual
    return parser


def _built(alphabet: str, samples: dict[str, list[str]], table: np.ndarray) -> CrossParser:
    langs, width, base, parts = sorted(samples), len(alphabet) + 2, 0, []
    roots = []
    for lang in langs:
        states = _automaton([c for text in samples[lang] for c in [*symbols(text, table).tolist(), SPACE] if c < width - 1])
        counts = np.fromiter(map(len, states), np.int64, len(states))
        total = int(counts.sum())
        on = np.fromiter((c for s in states for c in s), np.int64, total)
        to = np.fromiter((t for s in states for t in s.values()), np.int64, total) + base
        parts.append((np.repeat(np.arange(base, base + len(states)), counts), on, to))
        roots.append((on[: counts[0]], to[: counts[0]]))
        base += len(states)
    state, on, to = map(np.concatenate, zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3
    place = placed(state, on, base, width)
    goto = np.full(int(place.max(initial=0)) + width + 1, -1 << 32, np.int64)
    goto[place[state] + on] = place[state] << 32 | place[to]
    first = np.full((len(langs), width), DEAD, np.int64)
    for i, (symbol, then) in enumerate(roots):
        first[i, symbol] = place[then]
    return CrossParser(langs, alphabet, goto, first, np.ones(len(langs)))


def _walk(parser: CrossParser, flat: np.ndarray, state: np.ndarray, lang: np.ndarray, start: np.ndarray, size: np.ndarray, begins: np.ndarray, stop: bool) -> tuple[np.ndarray, np.ndarray]:
    """Parses each lane's stretch on from its state and marks in `begins` where phrases begin; (last states, lanes parsed to their end).

    With `stop`, a lane ends where a phrase begins that began there before: from there on all is as it was.
    """
    order = np.argsort(-size, kind="stable")
    size, live, at = size[order], state[order], start[order]
    place, row = lang[order] * len(flat) + at, lang[order] * parser.width
    last, whole, who = state.copy(), np.zeros(len(state), bool), order
    first, goto = parser.first.ravel(), parser.goto
    t = 0
    while len(live):
        n = int(np.searchsorted(-size, -t, "left"))  # lanes longer than t
        if n < len(live):
            last[who[n:]], whole[who[n:]] = live[n:], True
            size, live, at, place, row, who = size[:n], live[:n], at[:n], place[:n], row[:n], who[:n]
        c = flat.take(at + t)
        found = goto.take(live + c)
        anew = found >> 32 != live
        if stop:
            met = anew & begins.take(place + t)
            if met.any():
                on = ~met
                size, live, at, place, row, who, c, found, anew = (x[on] for x in (size, live, at, place, row, who, c, found, anew))
        begins[place + t] = anew
        live = found & 0xFFFFFFFF
        lost = np.flatnonzero(anew)
        live[lost] = first.take(row[lost] + c[lost])
        t += 1
    return last, whole


def phrases(parser: CrossParser, table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(greedy phrases of each language and text, symbols of each text, whether it has a letter).

    All stretches are parsed at once as if a phrase began with each. Then each goes on from
    the state in which the one before it ended, up to where both parses begin a phrase
    together, and again for stretches whose forerunner then ended otherwise. In the end no stretch
    shows in the result: it is that of parsing each whole text from its first symbol.
    """
    parts = [symbols(x, table) for x in texts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    letters = np.fromiter((bool((x != SPACE).any()) for x in parts), bool, len(parts))
    flat = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    out = np.zeros((len(parser.langs), len(parts)), np.int64)
    pieces = -(-lengths // STRETCH)
    owner = np.repeat(np.arange(len(parts)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = (np.cumsum(lengths) - lengths)[owner] + within * STRETCH
    size = np.minimum(STRETCH, lengths[owner] - within * STRETCH)
    step = max(1, GROUP_SYMBOLS // max(1, len(flat)))
    for lo in range(0, len(parser.langs), step):
        some = replace(parser, langs=parser.langs[lo : lo + step], first=parser.first[lo : lo + step])
        k, m = len(some.langs), len(owner)
        lane = lambda x: np.tile(x, k)  # noqa: B023, E731
        lang, starts, sizes = np.repeat(np.arange(k), m), lane(start), lane(size)
        begins = np.zeros(k * len(flat), bool)
        state, _ = _walk(some, flat, np.full(k * m, DEAD), lang, starts, sizes, begins, False)
        changed = np.arange(k * m)
        while True:
            follow = changed + 1
            follow = follow[follow < k * m]
            follow = follow[lane(within)[follow] > 0]
            if not len(follow):
                break
            ended, whole = _walk(some, flat, state[follow - 1], lang[follow], starts[follow], sizes[follow], begins, True)
            changed = follow[whole & (ended != state[follow])]
            state[follow[whole]] = ended[whole]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        for i in range(k):
            sums = np.zeros(len(flat) + 1, np.int32)
            np.cumsum(begins[i * len(flat) : (i + 1) * len(flat)], dtype=np.int32, out=sums[1:])
            out[lo + i] = np.diff(sums[bounds])
    return out, lengths, letters


def predictions(parser: CrossParser, table: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each text's language, len(langs) for none; score; phrases as a multiple of what is usual in that language)."""
    if not parser.langs:
        return np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.where([any(map(str.isalpha, x)) for x in texts], 0.0, np.inf)
    n, lengths, letters = phrases(parser, table, texts)
    per = n / np.maximum(1, lengths)
    two = np.sort(per, 0)[:2]
    with np.errstate(invalid="ignore"):
        score = np.where(letters, 1 - two[0] / two[1], 0.0) if len(two) > 1 else np.ones(len(texts))
    lang = per.argmin(0)
    strange = np.where(lengths >= LEAST, per[lang, np.arange(len(texts))] / parser.usual[lang], 1.0) if len(texts) else np.empty(0)
    return np.where(letters, lang, len(parser.langs)), np.where(letters, score, 0.0), np.where(letters, strange, np.inf)


def _identified(model, key: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser: CrossParser = model.value
        table = parser.classes()
        names = np.array([*parser.langs, UNDETERMINED], object)
        for batch in batches:
            for lo, hi, texts in slices(batch, SLICE_BYTES, column):
                lang, score, _ = predictions(parser, table, texts)
                yield pa.RecordBatch.from_pydict({key: batch.column(key).slice(lo, hi - lo), "lang_pred": pa.array(names[lang], pa.string()), "score": pa.array(score, pa.float64())})

    return run


def _determined(model, column: str, worst: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser: CrossParser = model.value
        table = parser.classes()
        for batch in batches:
            for lo, hi, texts in slices(batch, SLICE_BYTES, column):
                _, _, strange = predictions(parser, table, texts)
                yield batch.slice(lo, hi - lo).filter(pa.array(strange <= worst))

    return run


def fit(labelled: DataFrame, lang: str = "lang", column: str = "text", by: str = "doc_id", passages: int = PASSAGES, chars: int = PASSAGE_CHARS) -> CrossParser:
    """Learn every language from a bounded sample of the rows with a language and a text.

    Texts are cut into passages of `chars` characters and a hash of `by`, the text and the place
    chooses `passages` of each language in expectation, so no part of a text is preferred
    and the bound holds for long texts too. Copies of a passage count once. A language without a letter in its passages is not learned.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(column).isNotNull()).select(F.col(lang).alias("lang"), F.col(column).alias("text"), F.col(by).alias("by"))
    rows = rows.withColumn("n", F.ceil(F.length("text") / chars)).where("n > 0")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum("n")).collect()}
    samples: dict[str, list[str]] = {}
    if counts:
        share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, passages / n)])
        each = rows.withColumn("share", share[F.col("lang")]).withColumn("seed", F.xxhash64("by", "text")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        chance = F.pmod(F.xxhash64("seed", "i", F.lit("language")), F.lit(1_000_003)) / 1_000_003
        taken = each.withColumn("chance", chance).where("chance < share").select("lang", "chance", F.substring(F.col("text"), (F.col("i") * chars + 1).cast("int"), F.lit(chars)).alias("passage"))
        got = taken.dropDuplicates(["lang", "passage"]).collect()
        for name, _, passage in sorted(got):
            samples.setdefault(name, []).append(passage)
    return train({k: v for k, v in samples.items() if any(c.isalpha() for x in v for c in x)})


def identify(docs: DataFrame, parser: CrossParser, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, lang_pred, score of every whole text.

    score is 1 - phrases of the best language / phrases of the second (0: a tie, which the
    smaller language name wins). A text that is null or has no letters is `und` with score
    0, as is every text if nothing was learned. Rows are independent; repeated rows come
    out repeated, an empty table gives an empty result, other columns are not read. The
    model is a broadcast; its transitions grow with the sampled symbols of all languages, not with their alphabets. No shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(parser)
    return docs.select(key, column).mapInArrow(_identified(model, key, column), f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def drop_undetermined(docs: DataFrame, parser: CrossParser, column: str = "text", worst: float = WORST) -> DataFrame:
    """The rows of `docs`, all columns, whose text is in a learned language.

    Dropped are null texts, texts without letters, and texts of LEAST symbols or more whose best
    language needs more than `worst` times the phrases that unseen text of this language needs: other languages and noise.
    If nothing was learned, all texts with letters stay. No shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(parser)
    return docs.mapInArrow(_determined(model, column, worst), docs.schema)
