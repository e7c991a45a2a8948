"""Loading whole domains and benchmark tables as normalised examples."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from probewise.config import (
    BENCHMARK_CLAIM_PROMPT, DATASET_ALIASES, FLIPPED_DOMAINS, REPAIR_SOURCE, REPAIRED_DOMAINS)
from probewise.operators.normalize import normalize_or_fail
from probewise.operators.sampling import balanced_cap, exact_per_class
from probewise.operators.scopes import flip_labels
from probewise.operators.small import local_table, pinned
from probewise.schemas import EXAMPLES
from probewise.sources.discovery import listed_files, matching_files
from probewise.sources.tables import read_table
from probewise.workspace import written


def has_both_labels(rows: DataFrame) -> bool:
    return rows.agg(F.count_distinct("label").alias("n")).first()["n"] >= 2


def repair_one_class(rows: DataFrame, repair: DataFrame | None, domain: str) -> DataFrame:
    """Add truthful repair rows to domains that may come with one class only."""
    if repair is None or domain not in REPAIRED_DOMAINS or has_both_labels(rows):
        return rows
    return rows.unionByName(repair.withColumns({"domain": F.lit(domain), "label": F.lit(0)}))


@dataclass(frozen=True)
class Verdict:
    """What became of one candidate file."""

    domain: str
    path: str
    usable: bool
    reason: str


VERDICTS = "domain string, path string, usable boolean, reason string"


class NoUsableFile(ValueError):
    """A domain has no file to take; ``verdicts`` says why for each candidate."""

    def __init__(self, domain: str, verdicts: list[Verdict]):
        reasons = "; ".join(f"{v.path}: {v.reason}" for v in verdicts) or "no file name matches"
        super().__init__(f"nothing to load for {domain!r} ({reasons})")
        self.verdicts = verdicts


class Domains:
    """The domains under one folder: lists the files once, judges candidates in order, keeps the verdicts."""

    def __init__(self, spark: SparkSession, root: str, aliases: Mapping[str, Sequence[str]] = DATASET_ALIASES):
        self.spark, self.aliases = spark, aliases
        self.files = listed_files(spark, root).persist()
        self.verdicts: list[Verdict] = []

    def close(self) -> None:
        self.files.unpersist()

    def candidates(self, domain: str) -> list[str]:
        return [r["path"] for r in matching_files(self.files, domain, self.aliases).collect()]

    def judged(self, domain: str, path: str) -> tuple[DataFrame | None, Verdict]:
        """The examples of a file with both labels, repaired where the domain allows it."""
        try:
            rows = normalize_or_fail(read_table(self.spark, path), domain, path)
            complete = has_both_labels(rows)
            if not complete and domain in REPAIRED_DOMAINS and (spare := self.candidates(REPAIR_SOURCE)):
                rows = repair_one_class(rows, normalize_or_fail(read_table(self.spark, spare[0]), domain, spare[0]), domain)
                complete = has_both_labels(rows)
        except Exception as error:  # one unreadable file must not hide the others
            return None, Verdict(domain, path, False, f"{type(error).__name__}: {error}".splitlines()[0])
        if not complete:
            return None, Verdict(domain, path, False, "all rows have the same label")
        return rows, Verdict(domain, path, True, "taken")

    def first_usable(self, domain: str) -> DataFrame:
        seen: list[Verdict] = []
        for path in self.candidates(domain):
            rows, verdict = self.judged(domain, path)
            seen.append(verdict)
            if rows is not None:
                self.verdicts += seen
                return rows
        self.verdicts += seen
        raise NoUsableFile(domain, seen)

    def report(self) -> DataFrame:
        """(domain, path, usable, reason) of every file looked at."""
        return local_table(self.spark, [(v.domain, v.path, v.usable, v.reason) for v in self.verdicts], VERDICTS)


def capped(rows: DataFrame, cap: int | None, seed: int) -> DataFrame:
    """``rows``, or half of ``cap`` of each label where there are more rows than ``cap``."""
    if cap is None or rows.count() <= cap:
        return rows
    return balanced_cap(with_example_ids(rows), cap, seed).drop("example_id")


def load_domain(spark: SparkSession, root: str, domain: str, cap: int | None = None, seed: int = 0,
                aliases: Mapping[str, Sequence[str]] = DATASET_ALIASES) -> DataFrame:
    """The first file of a domain that can be read and has both labels."""
    domains = Domains(spark, root, aliases)
    try:
        return capped(domains.first_usable(domain), cap, seed)
    finally:
        domains.close()


def load_domains(spark: SparkSession, root: str, names: Iterable[str], cap: int | None = None, seed: int = 0,
                 aliases: Mapping[str, Sequence[str]] = DATASET_ALIASES,
                 flipped: Sequence[str] = FLIPPED_DOMAINS) -> tuple[DataFrame, DataFrame]:
    """All domains that load, with label fixes, and the verdicts on all files.

    A name without a candidate file has one verdict with an empty path.
    """
    domains, found = Domains(spark, root, aliases), local_table(spark, [], EXAMPLES)
    for name in names:
        try:
            found = found.unionByName(capped(domains.first_usable(name), cap, seed))
        except NoUsableFile as error:
            if not error.verdicts:
                domains.verdicts.append(Verdict(name, "", False, "no file name matches"))
    domains.close()
    return flip_labels(found, flipped), domains.report()


def with_example_ids(rows: DataFrame) -> DataFrame:
    """Number examples 0, 1, ... by their place in a written copy.

    The copy fixes the order: an id is the row's place in its file plus the rows of
    the files before it. Counting needs file footers only, and numbering no shuffle.
    """
    placed = written(rows, "examples").select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pinned(sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    return placed.join(offsets, "_file").select(
        (F.col("_offset") + F.col("_row")).cast("long").alias("example_id"), *rows.columns)


def paired_answers(questions: DataFrame, domain: str = "truthfulqa",
                   source_path: str = "local://paired_answers") -> DataFrame:
    """Two examples per question: the best answer (0) and the first incorrect one (1)."""
    wrong = F.get("incorrect_answers", F.lit(0))
    right = F.struct(F.col("best_answer").alias("assistant_text"), F.lit(0).alias("label"))
    false = F.struct(wrong.alias("assistant_text"), F.lit(1).alias("label"))
    answers = F.when(F.size("incorrect_answers") > 0, F.array(right, false)).otherwise(F.array(right))
    keep = [c for c in questions.columns if c not in ("question", "best_answer", "incorrect_answers")]
    return questions.select(*keep, F.col("question").alias("user_prompt"), F.explode(answers).alias("_a")).select(
        *keep, F.lit(domain).alias("domain"), "user_prompt", "_a.assistant_text", "_a.label",
        F.lit(source_path).alias("source_path"))


def sampled_claims(claims: DataFrame, per_class: int = 1000, seed: int = 0, row_id: str = "example_id",
                   domain: str = "fever", source_path: str = "local://claims") -> DataFrame:
    """``per_class`` supported (0) and refuted (1) claims; claims without verdict are left out."""
    verdict = F.when(F.col("label") == "SUPPORTS", 0).when(F.col("label") == "REFUTES", 1)
    usable = claims.filter(F.col("label") != "NOT ENOUGH INFO").withColumn("label", verdict).filter("label is not null")
    picked = exact_per_class(usable, per_class, seed, row_id)
    return picked.select(
        row_id, F.lit(domain).alias("domain"), F.lit(BENCHMARK_CLAIM_PROMPT).alias("user_prompt"),
        F.col("claim").alias("assistant_text"), "label", F.lit(source_path).alias("source_path"))


def load_benchmarks(spark: SparkSession, questions_path: str | None = None, claims_path: str | None = None,
                    per_class: int = 1000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Examples of the optional benchmark tables that can be read, and the verdicts on their files."""
    makers = {
        "truthfulqa": (questions_path, paired_answers),
        "fever": (claims_path, lambda table: sampled_claims(with_example_ids(table), per_class, seed)),
    }
    found, verdicts = local_table(spark, [], EXAMPLES), []
    for name, (path, make) in makers.items():
        if not path:
            continue
        try:
            found = found.unionByName(make(read_table(spark, path)).select(*EXAMPLES.fieldNames()))
            verdicts.append((name, path, True, "taken"))
        except Exception as error:  # the other table may still be there
            verdicts.append((name, path, False, f"{type(error).__name__}: {error}".splitlines()[0]))
    return found, local_table(spark, verdicts, VERDICTS)
