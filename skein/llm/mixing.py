"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source, language, topic). Raking starts from factors of one and multiplies, sweep by sweep
and one dimension after another, the factor of every cell by target / current tokens of its value in that dimension, so
the factored token counts approach all three target marginals at once. Sweeps go on until no marginal is off by more than
TOLERANCE of its target; targets that no factors can reach together end after MAX_SWEEPS, and `marginals` tells what came
out. Documents are then drawn by calibrated probabilities p = min(1, c * factor), where c makes the expected number of kept
tokens the wanted share; it is found in closed form by filling cells up to 1 from the largest factor on. A draw depends on
the id and the seed only, so it can be repeated anywhere.

The number of tokens is the number of runs of characters other than ASCII white space. The topic is the one of TOPICS with
the most words in the text (runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z became lower case), ties going to the
earlier topic, `general` if none has any.

Cells are counted with map-side combination, so a source with a third of all rows is no hot spot. Up to MAX_CELLS cells are
raked by numpy on the driver, more of them as a table; both give the same factors. Null sources and languages are the
value `(null)`. Null and empty texts have no tokens; they're drawn with their cell's probability. A value without tokens
keeps its factor. Ids that are null draw as the text `null`. Repeated rows share their draw. Extra columns are kept by
`sample` and not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lower, materialize, release, run_hashes, runs, spread_join, text_bounds, text_slices

DIMENSIONS = ("source", "lang", "topic")
#: Words of each topic in English, German, French and Spanish.
TOPICS = {
    "licensing": "license licensed licence licenses copyright copyrighted sublicense warranty lizenz lizenziert urheberrecht licencia licenciado droits derechos gpl mit apache bsd",
    "security": "password passwords token secret credential credentials encryption encrypted passwort schlüssel verschlüsselung clave contraseña chiffrement aws vulnerability firewall malware",
    "contact": "email mail phone telephone fax call contact address kontakt telefon adresse anschrift courriel téléphone contacto teléfono correo dirección",
    "programming": "code function class compiler software python java javascript database server api algorithm programm funktion datenbank logiciel fonction programa función datos variable debug linux",
    "science": "physics chemistry theory experiment hypothesis molecule atom energy quantum research physik chemie forschung versuch recherche expérience chimie física química investigación experimento",
    "medicine": "patient patients doctor hospital disease treatment vaccine symptom symptoms clinical arzt krankenhaus krankheit behandlung médecin hôpital maladie traitement médico enfermedad tratamiento salud",
    "business": "market markets company profit revenue investor shares economy bank customer unternehmen markt gewinn wirtschaft entreprise marché bénéfice économie empresa mercado beneficio economía",
    "law": "court judge lawsuit defendant plaintiff statute contract verdict attorney gericht richter gesetz vertrag tribunal juge avocat loi contrat juez ley abogado contrato",
    "politics": "government minister election parliament president senator policy vote campaign regierung wahl bundestag partei gouvernement élection ministre député gobierno elección partido",
    "sport": "football team match goal league player coach tournament olympic champion spiel mannschaft tor liga spieler équipe joueur entraîneur équipes equipo jugador partido liga",
    "travel": "hotel flight airport tourist journey beach passport luggage reise flug flughafen strand voyage vol aéroport plage viaje vuelo aeropuerto playa",
    "food": "recipe recipes oven sugar butter flour cook kitchen restaurant meal rezept zucker küche mehl recette sucre beurre cuisine receta azúcar cocina harina",
    "arts": "music film movie novel painting theatre album actor singer museum musik roman gemälde schauspieler musique peinture acteur chanson música película pintura novela",
    "education": "school student students teacher university lesson homework exam schule schüler lehrer universität unterricht école élève professeur université escuela alumno profesor universidad",
    "nature": "forest river mountain animal animals bird plant climate ocean wald fluss berg tier vogel forêt rivière montagne oiseau bosque río montaña pájaro clima",
    "religion": "church god prayer bible faith temple mosque priest kirche gott gebet glaube église dieu prière foi iglesia dios oración fe",
}
#: Targets by default: each value's share of tokens to this power, made to add up to one. It lifts what is rare.
TEMPER = 0.7
TOLERANCE = 1e-12
#: Where every sweep writes a table.
TABLE_TOLERANCE = 1e-9
MAX_SWEEPS = 1000
KEEP = 0.8
SEED = 1
MAX_CELLS = 1_000_000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Lexicon:
    """Topics by word hash. A word of several topics counts for each."""

    def __init__(self, topics: dict[str, str]):
        self.names = [*topics, "general"]
        pairs = sorted({(word, k) for k, words in enumerate(topics.values()) for word in words.lower().split()})
        raw = [word.encode() for word, _ in pairs]
        off = np.cumsum([0, *map(len, raw)])
        h = run_hashes(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:])
        self.words, self.slot = np.unique(h, return_inverse=True)
        self.of = np.zeros((len(self.words) + 1, len(topics)), np.int64)
        for slot, (_, k) in zip(self.slot.tolist(), pairs):
            self.of[slot, k] = 1

    def measure(self, buf: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Topic and number of tokens of each text."""
        n = len(off) - 1
        starts, _, doc = runs(~_SPACE[buf], off)
        tokens = np.diff(text_bounds(doc, n))
        buf = lower(buf)
        starts, ends, doc = runs(_WORD[buf], off)
        if not len(self.words) or not len(starts):
            return [self.names[-1]] * n, tokens
        h = run_hashes(buf, starts, ends)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = np.flatnonzero(self.words[at] == h)
        count = np.zeros((n, self.of.shape[1]), np.int64)
        np.add.at(count, doc[hit], self.of[at[hit]])
        best = np.where(count.max(axis=1) > 0, count.argmax(axis=1), len(self.names) - 1)
        return [self.names[k] for k in best.tolist()], tokens


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number from 0 up to 1 that follows from the id."""
    text = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _targets(tokens: np.ndarray, code: np.ndarray, names: np.ndarray, wanted: dict[str, float] | None) -> np.ndarray:
    """Target tokens of each value of a dimension."""
    total, size = tokens.sum(), np.bincount(code, tokens, len(names))
    share = np.array([wanted.get(n, 0.0) for n in names]) if wanted is not None else (size / total if total else size) ** TEMPER
    return share / share.sum() * total if share.sum() else size


def _dimensions(cells: pd.DataFrame, targets: dict[str, dict[str, float]] | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each dimension the cells' codes, the target of each code, and its name."""
    tokens, dims = cells["tokens"].to_numpy(float), []
    for d in DIMENSIONS:
        code, names = pd.factorize(cells[d], sort=True)
        dims.append((code, _targets(tokens, code, np.asarray(names), (targets or {}).get(d)), np.asarray(names)))
    return dims


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]] | None = None, sweeps: int = MAX_SWEEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Factors of cells with columns source, lang, topic, tokens."""
    tokens, factor, dims = cells["tokens"].to_numpy(float), np.ones(len(cells)), _dimensions(cells, targets)
    for _ in range(sweeps):
        off = 0.0
        for code, want, _ in dims:
            now = np.bincount(code, tokens * factor, len(want))
            step = np.where(now > 0, want / np.where(now > 0, now, 1), 1)
            off = max(off, np.abs(step - 1).max(initial=0))
            factor = factor * step[code]
        if off < tolerance:
            break
    return factor


def marginals(cells: pd.DataFrame, factor: np.ndarray, targets: dict[str, dict[str, float]] | None = None) -> pd.DataFrame:
    """(dimension, value, tokens, target, weighted): what raking aimed at and what the factors give."""
    tokens, out = cells["tokens"].to_numpy(float), []
    for d, (code, want, names) in zip(DIMENSIONS, _dimensions(cells, targets)):
        now, weighted = np.bincount(code, tokens, len(want)), np.bincount(code, tokens * factor, len(want))
        out += [(d, *r) for r in zip(names.tolist(), now.tolist(), want.tolist(), weighted.tolist())]
    return pd.DataFrame(out, columns=["dimension", "value", "tokens", "target", "weighted"])


def rake_table(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, sweeps: int = MAX_SWEEPS, tolerance: float = TABLE_TOLERANCE) -> DataFrame:
    """rake() for more cells than the driver should hold; cells are written to the shared folder after each sweep."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    wants = []
    for d in DIMENSIONS:
        size = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("size"))
        if (wanted := (targets or {}).get(d)) is not None:
            shares = size.join(spark.createDataFrame(list(wanted.items()) or [("", 0.0)], f"{d} string, share double"), d, "left").fillna(0.0, ["share"])
        else:
            shares = size.withColumn("share", F.pow(F.col("size") / (total or 1.0), F.lit(TEMPER)))
        whole = shares.agg(F.sum("share")).first()[0] or 0.0
        wants.append(materialize(shares.select(d, (F.col("share") / whole * total if whole else F.col("size")).alias("want"))))
    out = cells.withColumn("factor", F.lit(1.0))
    for _ in range(sweeps):
        off = 0.0
        for d, want in zip(DIMENSIONS, wants):
            now = out.groupBy(d).agg(F.sum(F.col("tokens") * F.col("factor")).alias("now")).join(want, d)
            step = materialize(now.select(d, F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(1.0).alias("step")))
            off = max(off, step.agg(F.max(F.abs(F.col("step") - 1))).first()[0] or 0.0)
            out = spread_join(out, step, [d], list(DIMENSIONS)).select(*DIMENSIONS, "tokens", (F.col("factor") * F.col("step")).alias("factor"))
        out = materialize(out)
        if off < tolerance:
            break
    return out


def calibrate(tokens: np.ndarray, factor: np.ndarray, keep: float) -> float:
    """c such that sum(tokens * min(1, c * factor)) is the kept share of all tokens; if that's out of reach, all with a factor are kept."""
    if keep * tokens.sum() >= tokens[factor > 0].sum():
        return float(1 / factor[factor > 0].min(initial=1.0))
    order = np.argsort(-factor, kind="stable")
    t, f = tokens[order], factor[order]
    full = np.cumsum(t) - t
    rest = np.cumsum((t * f)[::-1])[::-1]
    c = (keep * t.sum() - full) / np.where(rest > 0, rest, np.inf)
    return float(c[np.flatnonzero((c * f <= 1 + 1e-12) & (rest > 0))[0]])


ADDED = (*DIMENSIONS, "tokens", "weight", "prob", "draw")


def names_in(docs: DataFrame) -> dict[str, str]:
    """The names under which named_cells() and weigh() add their columns: `__source` and so on, longer where docs has that name."""
    return {k: fresh(docs, f"__{k}") for k in ADDED}


def named_cells(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, topics: dict[str, str] | None = None) -> DataFrame:
    """docs with columns __source, __lang, __topic and __tokens."""
    lexicon, n = Lexicon(TOPICS if topics is None else topics), names_in(docs)

    @F.arrow_udf("topic string, tokens long")
    def measure(texts: pa.Array) -> pa.Array:
        topic, tokens = [], []
        for _, _, buf, off in text_slices(texts):
            a, b = lexicon.measure(buf, off)
            topic += a
            tokens += b.tolist()
        release()
        return pa.StructArray.from_arrays([pa.array(topic, pa.string()), pa.array(tokens, pa.int64())], ["topic", "tokens"])

    both = fresh(docs, "__both")
    out = docs.select(
        "*", F.coalesce(F.col(source).cast("string"), F.lit("(null)")).alias(n["source"]), F.coalesce(F.col(lang).cast("string"), F.lit("(null)")).alias(n["lang"]), measure(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias(both)
    )
    told = F.col(both)["topic"] if topic is None else F.coalesce(topic, F.lit("(null)"))
    return out.withColumns({n["topic"]: told, n["tokens"]: F.col(both)["tokens"]}).drop(both)


def weigh(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, named: DataFrame | None = None) -> DataFrame:
    """docs with columns __source, __lang, __topic, __tokens, __weight (the factor), __prob and __draw, named as names_in(docs) says.

    named: what named_cells(docs) gave, if the caller kept it. Else texts are measured twice, for the cells and for the
    rows; keeping them would write every text once more. Only texts go to Python.
    """
    spark, n = docs.sparkSession, names_in(docs)
    if named is None:
        lean = docs.select(text, source, lang) if topic is None else docs
        m = names_in(lean)
        counted, named = named_cells(lean, text, source, lang, topic), named_cells(docs, text, source, lang, topic)
    else:
        counted, m = named, n
    cells = materialize(counted.groupBy(*[F.col(m[d]).alias(d) for d in DIMENSIONS]).agg(F.sum(m["tokens"]).alias("tokens")))
    if cells.limit(MAX_CELLS + 1).count() <= MAX_CELLS:
        held = cells.toPandas().sort_values(list(DIMENSIONS)).reset_index(drop=True)
        held["factor"] = rake(held, targets)
        c = calibrate(held["tokens"].to_numpy(float), held["factor"].to_numpy(), keep) if len(held) else 1.0
        raked = spark.createDataFrame(held, "source string, lang string, topic string, tokens long, factor double")
    else:
        raked = rake_table(cells, targets)
        c = _calibrate_table(raked, keep)
    look = raked.select(*[F.col(d).alias(n[d]) for d in DIMENSIONS], F.col("factor").alias(n["weight"]), F.least(F.lit(1.0), F.lit(c) * F.col("factor")).alias(n["prob"]))
    return spread_join(named, look, [n[d] for d in DIMENSIONS], [doc_id]).withColumn(n["draw"], draw(F.col(doc_id)))


def _calibrate_table(raked: DataFrame, keep: float) -> float:
    """calibrate() by bisection over aggregates."""
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    reach = raked.where("factor > 0").agg(F.sum("tokens").alias("t"), F.min("factor").alias("f")).first()
    if keep * total >= (reach["t"] or 0):
        return 1 / min(1.0, reach["f"] or 1.0)
    lo, hi = 0.0, 1.0
    kept = lambda c: raked.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(c) * F.col("factor")))).first()[0] or 0.0
    while kept(hi) < keep * total * (1 - 1e-12):
        lo, hi = hi, hi * 2
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if kept(mid) < keep * total else (lo, mid)
    return hi


def sample(docs: DataFrame, keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The drawn rows of docs; columns as they were."""
    n = names_in(docs)
    return weigh(docs, targets, keep).where(F.col(n["draw"]) < F.col(n["prob"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    # Texts are read once: what is counted of them is a few bytes a document.
    w = weigh(docs, named=materialize(named_cells(docs).drop("text")))
    return w.select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"),
        F.round("__weight", 6).alias("weight"), F.round("__prob", 6).alias("prob"), (F.col("__draw") < F.col("__prob")).alias("kept"),
    )


#: Sweeps in SQL, which can't stop early: far more than the small tables need to settle.
SQL_SWEEPS = 200


def op1_sql() -> str:
    """The same in SQL. Raking is a fold over sweeps whose state is the list of all factors."""
    upper, lower_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = ", ".join(f"('{w}', {k})" for k, ws in enumerate(TOPICS.values()) for w in sorted(set(ws.lower().split())))
    names = ", ".join(f"({k}, '{t}')" for k, t in enumerate(TOPICS))
    parts = [
        f"lex(word, k) AS (VALUES {words})", f"topics(k, topic) AS (VALUES {names})",
        rf"w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower_}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents)",
        "b AS (SELECT doc_id, arg_min(topic, -n * 1000 + k) AS topic FROM (SELECT doc_id, k, count(*) AS n FROM w JOIN lex USING (word) GROUP BY ALL) JOIN topics USING (k) GROUP BY doc_id)",
        r"d AS MATERIALIZED (SELECT x.doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens, coalesce(b.topic, 'general') AS topic FROM documents x LEFT JOIN b ON b.doc_id = x.doc_id)",
        "c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source, lang, topic) AS k FROM (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL))",
    ]
    for d in DIMENSIONS:
        parts.append(f"s_{d} AS (SELECT {d}, pow(sum(tokens) / (SELECT sum(tokens) FROM c), {TEMPER}) AS share, list(k) AS ks, row_number() OVER (ORDER BY {d}) AS v FROM c GROUP BY {d})")
        parts.append(f"m_{d} AS MATERIALIZED (SELECT list(ks ORDER BY v) AS ks, list(share / (SELECT sum(share) FROM s_{d}) * (SELECT sum(tokens) FROM c) ORDER BY v) AS want FROM s_{d})")
        parts.append(f"v_{d} AS MATERIALIZED (SELECT list(v ORDER BY k) AS vs FROM c JOIN s_{d} USING ({d}))")
    # A fold over two lists serves to name a value, so that nothing is computed twice.
    state = "f"
    for i, d in enumerate(DIMENSIONS):
        now = f"list_transform(m{i}.ks, lambda ks{i}: list_sum(list_transform(ks{i}, lambda k{i}: t.ts[k{i}] * a{i}[k{i}])))"
        step = f"list_transform(m{i}.want, lambda y{i}, j{i}: CASE WHEN n{i}[j{i}] > 0 THEN y{i} / n{i}[j{i}] ELSE 1 END)"
        scaled = f"list_reduce([b{i}, {step}], lambda f{i}, s{i}: list_transform(f{i}, lambda x{i}, j{i}: x{i} * s{i}[v{i}.vs[j{i}]]))"
        state = f"list_reduce([{state}, CAST([] AS DOUBLE[])], lambda a{i}, z{i}: list_reduce([a{i}, {now}], lambda b{i}, n{i}: {scaled}))"
    joins = " CROSS JOIN ".join(f"m_{d} m{i} CROSS JOIN v_{d} v{i}" for i, d in enumerate(DIMENSIONS))
    parts += [
        f"r AS MATERIALIZED (SELECT list_reduce(list_concat([list_transform(t.ts, lambda x: CAST(1 AS DOUBLE))], list_transform(range({SQL_SWEEPS}), lambda i: CAST([] AS DOUBLE[]))), lambda f, nothing: {state}) AS fs FROM (SELECT list(tokens ORDER BY k) AS ts FROM c) t CROSS JOIN {joins})",
        "raked AS MATERIALIZED (SELECT source, lang, topic, tokens, fs[k] AS f FROM c, r)",
        "o AS (SELECT *, coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, sum(tokens * f) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER w AS k FROM raked WINDOW w AS (ORDER BY f DESC, source, lang, topic))",
        f"cal AS (SELECT arg_min(({KEEP} * (SELECT sum(tokens) FROM c) - filled) / rest, k) AS c FROM o WHERE rest > 0 AND ({KEEP} * (SELECT sum(tokens) FROM c) - filled) / rest * f <= 1 + 1e-12)",
    ]
    return (
        "WITH " + ", ".join(parts) + f" SELECT doc_id, source, lang, topic, n_tokens, round(f, 6) AS weight, round(least(1.0, c * f), 6) AS prob, "
        f"CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{SEED}'), 1, 8)) AS BIGINT) / 4294967296.0 < least(1.0, c * f) AS kept "
        "FROM d JOIN raked USING (source, lang, topic) CROSS JOIN cal"
    )
