"""Subject areas of commit documents: labelling functions whose accuracies a latent model learns."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import broadcast_checked, cut, table

WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")  # words, and the parts of identifiers
DIFF = re.compile(r"^(?:diff --git |Index: |--- |@@ |Binary files |GIT binary )", re.M)
CHANGED = re.compile(r"^[+-](?!(?:\+\+|--) )[^\r\n]*", re.M)
PATHS = re.compile(r"^(?:diff --git |Index: |--- |\+\+\+ )[^\r\n]*", re.M)
#: Header lines of patch mails, git, Mercurial and Subversion logs, and first lines that git (merges), update robots
#: and release tools write into messages.
HEADER = re.compile(r"^(?:commit [0-9a-f]{7,}|From [0-9a-f]{7,}|(?:Author|Date|From|Commit|AuthorDate|CommitDate|Signed-off-by|Co-authored-by):|# (?:HG changeset|User|Date|Node ID|Parent|Branch)|r\d+ \|)[^\r\n]*", re.M)
SUBJECT_LINE = re.compile(r"^\s*(?:Subject: *(?:\[[^\]\n]*\] *)?)?(?=\S)", re.M)
AUTOMATIC = re.compile(r"(?:Merge (?:branch|pull request|remote|tag|commit)\b|Bump \S+ from |chore\(deps\)|Release v?\d|\[auto\]|Automatic )")


@dataclass(frozen=True)
class Settings:
    """``labels`` rows of rated documents at most fit the first lexicon (the bound of that sample). A term of the final one is one
    that surely (by the lower bound of a 95 % interval) has a part of more than ``own`` of its documents about one subject, and
    more than ``clear`` of those that are about this or the next subject: rare terms need no part of the corpus, only evidence.
    More than ``lexicon`` terms or ``subjects`` subjects are refused. ``posterior`` is the least one of a subject that counts."""

    labels: int = 20_000
    own: float = 0.5
    clear: float = 0.7
    lexicon: int = 500_000
    posterior: float = 0.5
    subjects: int = 1000


def surely(k: Column, n: Column, z: float = 2.0) -> Column:
    """The lower end of the Wilson interval of a part of ``k`` in ``n``."""
    p = F.least(k / n, F.lit(1.0))
    return (p + z * z / 2 / n - z * F.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)


def folded(text: str) -> str:
    """Without accents, so that a term is the same in running text and in identifiers."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text.replace("ß", "ss")) if not unicodedata.combining(c))


def sections(text: str) -> tuple[str, str, str]:
    """The message without header lines, the changed lines, and the lines with file names of a document."""
    text = folded(text)
    at = DIFF.search(text)
    head, tail = (text[: at.start()], text[at.start() :]) if at else (text, "")
    return HEADER.sub("", head), "\n".join(CHANGED.findall(tail)), "\n".join(PATHS.findall(tail))


def is_automatic(message: str) -> bool:
    first = SUBJECT_LINE.search(message)
    return bool(first and AUTOMATIC.match(message, first.end()))


def term_set(text: str) -> set[str]:
    return {w.lower() for w in set(WORD.findall(text)) if len(w) > 2}


def cases(lexicon: dict[str, tuple]) -> dict[str, tuple]:
    """The lexicon under each term's lower, capital and upper spelling: saves lower-casing every word."""
    return {s: v for w, v in lexicon.items() for s in (w, w.capitalize(), w.upper())}


def rated_terms(docs: DataFrame, labels: DataFrame, id_col: str, text: str, names: list[str], settings: Settings) -> DataFrame:
    """``term, subject, n``: documents with the term among those rated with the subject, over a bounded sample of labels."""
    rated = labels.select(F.col(id_col), F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(names)).distinct()
    rated = cut(rated.orderBy(F.xxhash64(id_col), "subject").limit(settings.labels))
    joined = docs.select(id_col, text).join(broadcast_checked(rated, settings.labels), id_col).select("subject", text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for subject, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                message, changed, _ = sections(t or "")
                seen.update((w, subject) for w in term_set(message) | term_set(changed))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "subject", "n"])

    return joined.mapInArrow(count, "term string, subject string, n bigint").groupBy("term", "subject").agg(F.sum("n").alias("n"))


def first_lexicon(rated: DataFrame, seeds: dict[str, list[str]], names: list[str]) -> dict[str, str]:
    """Terms that stand out in the rated documents of one subject: its part among them lies at least 45 % of the way from the
    subject's part of all mentions to 1. With them the subjects' sample words. Its size is bounded by the sample of
    labels."""
    rated = cut(rated)
    mentions = {r.subject: r.n for r in rated.groupBy("subject").agg(F.sum("n").alias("n")).collect()}
    total = sum(mentions.values()) or 1
    bar = F.create_map(*[F.lit(x) for s in names for x in (s, 0.45 + 0.55 * mentions.get(s, 0) / total)])
    best = rated.groupBy("term").agg(F.max(F.struct("n", "subject")).alias("best"), F.sum("n").alias("all"))
    best = best.where((F.col("best.n") >= 3) & (F.col("best.n") >= F.element_at(bar, F.col("best.subject")) * F.col("all")))
    lexicon = {r.term: r.best.subject for r in best.collect()}
    for name in names:
        lexicon.update((w, name) for w in seeds[name])
    return lexicon


def corpus_terms(docs: DataFrame, text: str, lexicon: dict[str, str], settings: Settings) -> DataFrame:
    """``term, df, subject, n, second, joint`` over all documents: a term's documents, the subject that most of them deal with by
    two or more other terms of ``lexicon``, how many do, how many deal with the next subject, and the lexicon term that most
    often stands right after it with how often, and how often each occurs (``joint``)."""
    lookup = cases({w: (w, s) for w, s in lexicon.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["term", "what", "n"])
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                message, changed, _ = sections(t)
                words = WORD.findall(message)
                words += WORD.findall(changed)
                terms = {w.lower() for w in set(words) if len(w) > 2}
                known = {w: lexicon[w] for w in terms if w in lexicon}
                about = Counter(known.values())
                some, many = [s for s, n in about.items() if n >= 2], {s for s, n in about.items() if n >= 3}
                for w in terms:
                    seen[w, "df"] += 1
                    own = known.get(w)
                    for s in some:
                        if s in many or s != own:
                            seen[w, "=" + s] += 1
                last = None
                for w in words:
                    hit = lookup.get(w)
                    if hit:
                        seen[hit[0], "tf"] += 1
                        if last and last[1] == hit[1] and last[0] != hit[0]:
                            seen[last[0], ">" + hit[0]] += 1
                    last = hit
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    return docs.select(text).mapInArrow(count, "term string, what string, n bigint").groupBy("term", "what").agg(F.sum("n").alias("n"))


def final_lexicon(counts: DataFrame, lexicon: dict[str, str], settings: Settings) -> dict[str, tuple[str, str]]:
    """``term -> (name of the term, subject)`` of the terms that surely belong to a subject, and of those of the first lexicon that
    likely do, which matters where the corpus is small. Words that form one term (each nearly always beside the other) get one
    name."""
    counts = cut(counts)
    subject = F.startswith("what", F.lit("="))
    ranked = counts.groupBy("term").agg(F.max(F.when(F.col("what") == "df", F.col("n"))).alias("df"), F.max(F.when(subject, F.struct("n", "what"))).alias("best"), F.sort_array(F.collect_list(F.when(subject, F.col("n"))), asc=False).alias("all"))
    n, next_ = F.col("best.n"), F.coalesce(F.try_element_at("all", F.lit(2)), F.lit(0))
    known = counts.sparkSession.createDataFrame([(w,) for w in lexicon], "term string").withColumn("known", F.lit(True)).coalesce(1)
    ranked = ranked.join(F.broadcast(known), "term", "left")
    sure = (surely(n, F.col("df")) >= settings.own) & (surely(n, n + next_) >= settings.clear)
    likely = F.col("known") & (n >= 3) & (n >= 0.72 * F.col("df")) & (n >= 4 * next_)
    kept = ranked.where(sure | F.coalesce(likely, F.lit(False))).select("term", "best").limit(settings.lexicon + 1).collect()
    if len(kept) > settings.lexicon:
        raise ValueError(f"more than {settings.lexicon} terms")
    terms = {r.term: r.best.what[1:] for r in kept}
    often = {r.term: r.n for r in counts.where("what = 'tf'").collect()}
    names = {w: w for w in terms}
    for r in counts.where(F.startswith("what", F.lit(">"))).collect():  # pairs of lexicon terms
        a, b = r.term, r.what[1:]
        if a in terms and b in terms and terms[a] == terms[b] and r.n >= 0.7 * max(often[a], often[b]):
            names[b] = names[a]
    return {w: (names[w], s) for w, s in terms.items()}


VOTES = "subject string, message int, changed int, both int, address int"


def votes(docs: DataFrame, id_col: str, text: str, repo: str, lexicon: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each document and subject of which a term stands in the message, a changed line or a file name: distinct terms
    in the message, in the changed lines and in both together, and whether a term stands in a file name."""
    lookup = cases(lexicon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                if not t:
                    continue
                message, changed, paths = sections(t)
                if is_automatic(message):
                    continue
                found = [{lookup[w] for w in set(WORD.findall(part)) if w in lookup} for part in (message, changed)]
                named = {lookup[w][1] for w in set(WORD.findall(paths)) if w in lookup}
                n = [Counter(s for _, s in part) for part in (*found, found[0] | found[1])]
                for s in n[2].keys() | named:
                    rows.append(i)
                    out.append((s, n[0][s], n[1][s], n[2][s], int(s in named)))
            ids = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array([o[0] for o in out], pa.string()), *(pa.array([o[k] for o in out], pa.int32()) for k in (1, 2, 3, 4))], names=["id", "repo", "subject", "message", "changed", "both", "address"])

    kinds = docs.schema
    return docs.select(F.col(id_col).alias("id"), F.col(repo).alias("repo"), text).mapInArrow(count, f"id {kinds[id_col].dataType.simpleString()}, repo {kinds[repo].dataType.simpleString()}, {VOTES}")


def latent_model(patterns: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior of the latent truth for each pattern of votes (rows of small integers, seen ``n`` times): expectation
    maximisation over the labelling functions' confusion tables, from the first guess ``start``."""
    posterior = start.astype(float)
    for _ in range(rounds):
        log = np.zeros((len(n), 2))
        for y, weight in ((0, n * (1 - posterior)), (1, n * posterior)):
            log[:, y] = np.log(weight.sum() + 1)
            for k in range(patterns.shape[1]):
                seen = np.bincount(patterns[:, k], weights=weight, minlength=patterns[:, k].max() + 1) + 0.5
                log[:, y] += np.log(seen / seen.sum())[patterns[:, k]]
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        if np.abs(new - posterior).max() < 1e-6:
            return new
        posterior = new
    return posterior


def subject_posteriors(docs: DataFrame, labels: DataFrame, subjects: DataFrame, *, id_col: str = "doc_id", text: str = "text", repo: str = "repo", settings: Settings = Settings()) -> DataFrame:
    """``id_col, subject, terms, posterior`` of every document and subject of which some term stands in the message, the changed lines
    or a file name.

    A bounded sample of rated documents and the subjects' sample words give a first lexicon. All documents then say, for
    every term of the corpus, which subject its documents deal with by other terms; this drops words that several subjects
    share and adds what the sample lacks. Four labelling functions vote on each document and subject: the lexicon (how many
    distinct terms), the sections they stand in (message, changed lines, both), the address (file names), and the
    source (the share of the repository's documents that are about the subject). How often each pattern of votes occurs goes
    into a latent model (at most 5*4*2*3 patterns a subject, whatever the corpus), which learns without labels how each
    function votes on documents that are about a subject and on those that only mention it. Its posterior alone decides.

    Defined results: null and empty texts, messages that programs write and documents without terms have no row; a null
    repository is one of its own; of a repeated document id the texts count one by one and the best row stands; subjects are
    lower-cased and trimmed, and other names in ``labels`` are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    listed = subjects.where("subject IS NOT NULL").select("subject", "sample_words").limit(settings.subjects + 1).collect()
    if len(listed) > settings.subjects:
        raise ValueError(f"more than {settings.subjects} subjects")
    known = {r.subject.strip().lower(): sorted(term_set(folded(r.sample_words or ""))) for r in listed}
    names = sorted(known)
    first = first_lexicon(rated_terms(docs, labels, id_col, text, names, settings), known, names)
    lexicon = final_lexicon(corpus_terms(docs, text, first, settings), first, settings)
    votes_ = cut(votes(docs, id_col, text, repo, lexicon))

    repos = docs.groupBy(F.coalesce(repo, F.lit("")).alias("repo")).agg(F.count(F.lit(1)).alias("docs"))
    about = votes_.where("both >= 3").groupBy(F.coalesce("repo", F.lit("")).alias("repo"), "subject").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.col("docs")
    source = cut(about.join(repos, "repo").select("repo", "subject", F.when(share >= 0.25, 2).when(share >= 0.1, 1).otherwise(0).alias("source")).where("source > 0"))

    keyed = votes_.withColumn("repo", F.coalesce("repo", F.lit(""))).join(broadcast_checked(source), ["repo", "subject"], "left")
    sections_ = (F.col("message") > 0).cast("int") + 2 * (F.col("changed") > 0).cast("int")
    v = ["lexicon", "section", "address", "source"]
    voted = cut(keyed.select("id", "subject", "both", F.least("both", F.lit(4)).alias("lexicon"), sections_.alias("section"), "address", F.coalesce("source", F.lit(0)).alias("source")))
    seen = voted.groupBy("subject", *v).agg(F.count(F.lit(1)).alias("n")).collect()  # 5*4*2*3 patterns a subject at most
    rows: list[tuple] = []
    for name in names:
        mine = sorted((tuple(r[x] for x in v), r.n) for r in seen if r.subject == name)
        if mine:
            patterns = np.array([p for p, _ in mine])
            start = np.clip((patterns / np.maximum(patterns.max(0), 1)).mean(1), 0.05, 0.95)
            posterior = latent_model(patterns, np.array([n for _, n in mine], float), start)
            rows += [(name, *p, float(q)) for (p, _), q in zip(mine, posterior)]
    table_ = F.broadcast(spark.createDataFrame(rows, "subject string, lexicon int, section int, address int, source int, posterior double"))
    best = voted.join(table_, ["subject", *v]).groupBy("id", "subject").agg(F.max("both").alias("terms"), F.max("posterior").alias("posterior"))
    return best.withColumnRenamed("id", id_col)


def p9_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_posteriors(*(table(spark, sf_dir, t) for t in ("documents", "doc_labels", "subjects")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_posteriors(spark, sf_dir).where(F.col("posterior") >= Settings().posterior).select("doc_id", "subject")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of all documents that is about each subject."""
    total = table(spark, sf_dir, "documents").count()
    return p9_found(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("docs")).withColumn("share", F.round(F.col("docs") / total, 4))


QUERIES = {"p9_posteriors": p9_posteriors, "p9_found": p9_found, "p9_shares": p9_shares}
ORACLE: dict[str, str] = {}
