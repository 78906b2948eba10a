"""The tables one analysis leaves behind, each built on first use and kept for the session.

Lines are ingested once into stored events; scores, incidents and indexes are
written tables over those, as in a real deployment where many queries read
what one ingest wrote.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators import correlate as C
from timberline.operators import incremental as I
from timberline.operators import narrative as N
from timberline.operators import retrieval as R
from timberline.operators import scoring as SC
from timberline.operators import sequences as Q
from timberline.operators import templates as T
from timberline.operators.normalize import normalize
from timberline.plans import fixture
from timberline.session import cut, new_path, prepare, scratch

QUESTIONS = (
    (1, "which request failed for user after 6 retries"),
    (2, "stored block of size at hex address"),
    (3, "user registered from 10.0.3.77"),
    (4, "quantum flux capacitor"),
)

#: What an event tells in a passage or an answer, and what else its score needs.
SCORED_BY = ("template_id", "timestamp_epoch")
TOLD = ("dataset", "id", "timestamp", "level", "service", "message")

_OPEN: dict[tuple[str, str], "Tables"] = {}


def tables(spark: SparkSession, sf_dir: str) -> "Tables":
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Tables(prepare(spark), sf_dir)
    return _OPEN[key]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return fixture.table(self.spark, self.sf_dir, name)

    def new_path(self, label: str) -> str:
        return new_path(self.spark, label)

    # -- lines and events ----------------------------------------------------
    @property
    def lines(self) -> DataFrame:
        return fixture.log_lines(self.spark, self.sf_dir)

    @property
    def parsed(self) -> DataFrame:
        """Events as a plan over the lines (nothing stored)."""
        return normalize(self.lines, "dialect", fixture.YEAR)

    @cached_property
    def events(self) -> DataFrame:
        return cut(self.parsed, "events")

    @cached_property
    def all_events(self) -> DataFrame:
        lines = fixture.log_lines(self.spark, self.sf_dir, single=True)
        return cut(normalize(lines, "dialect", fixture.YEAR), "all-events")

    @cached_property
    def text_dir(self) -> str:
        """The lines as text files, in order, one folder per dataset; a blank line
        precedes every error event."""
        kind = self.table("events").select("event_id", "event_type")
        value = F.explode(
            F.when(F.col("event_type") == "error", F.array(F.lit(""), F.col("line"))).otherwise(F.array("line"))
        )
        path = new_path(self.spark, "text")
        (
            self.lines.join(kind, "event_id")
            .select("dataset", "event_id", value.alias("value"))
            .withColumn("k", F.when(F.col("value") == "", 0).otherwise(1))
            .repartitionByRange(4, "dataset", "event_id")
            .sortWithinPartitions("dataset", "event_id", "k")
            .select("dataset", "value")
            .write.partitionBy("dataset").text(path)
        )
        return path

    # -- scores, incidents ---------------------------------------------------
    @cached_property
    def scored(self) -> DataFrame:
        return cut(SC.score_core(self.events), "scored")

    @cached_property
    def all_scored(self) -> DataFrame:
        return cut(SC.score_core(self.all_events), "all-scored")

    @cached_property
    def stateless(self) -> DataFrame:
        return cut(SC.score_stateless(self.events), "stateless")

    @cached_property
    def correlation(self) -> C.Correlation:
        """Over the scores if they are written already, else only rows that may be candidates are scored."""
        known = "scored" in self.__dict__
        return C.correlate(self.scored if known else SC.score_core(self.events, least=C.LEAST_SCORE))

    @property
    def members(self) -> DataFrame:
        return self.correlation.members

    @cached_property
    def rollup(self) -> DataFrame:
        return cut(C.incident_rollup(self.members), "rollup")

    @cached_property
    def narratives(self) -> DataFrame:
        return cut(N.incident_narrative(self.members), "narratives")

    # -- sequences and templates ---------------------------------------------
    @cached_property
    def sessions(self) -> DataFrame:
        return cut(Q.entity_sessions(self.events), "sessions")

    @cached_property
    def pairs(self) -> DataFrame:
        return cut(Q.transitions(self.sessions), "pairs")

    @cached_property
    def mined(self) -> DataFrame:
        return cut(T.mine_templates(self.events), "mined")

    @cached_property
    def leaves(self) -> DataFrame:
        return cut(T.template_leaves(T.masked_texts(self.events)), "leaves")

    # -- retrieval -------------------------------------------------------------
    @cached_property
    def ordered(self) -> DataFrame:
        """Scored events in order, with the columns that passages and answers tell. The wide events are not moved,
        and read only if another query had them written; what is written on the way goes when the order stands."""
        kept, datasets = self.new_path("ordered"), self.new_path("datasets")
        with scratch(self.spark):
            events = self.events if "events" in vars(self) else cut(self.parsed.select(*SCORED_BY, *TOLD), "events-told")
            told = cut(SC.score_core(events).select(*TOLD, "is_anomaly"), "told")
            self.datasets = cut(told.select("dataset").distinct(), path=datasets)
            return cut(R.ordered_events(told), path=kept)

    @cached_property
    def datasets(self) -> DataFrame:
        """Names of the datasets, written with ``ordered``."""
        self.ordered
        return self.__dict__["datasets"]

    @cached_property
    def all_ordered(self) -> DataFrame:
        return cut(R.ordered_events(self.all_scored), "all-ordered")

    @cached_property
    def passages(self) -> DataFrame:
        return cut(R.passages(self.ordered), "passages")

    @cached_property
    def index(self) -> R.TermIndex:
        return R.TermIndex(self.passages)

    @property
    def questions(self) -> DataFrame:
        return self.spark.createDataFrame(QUESTIONS, "question_id long, text string")

    @cached_property
    def found(self) -> DataFrame:
        return cut(self.index.search(self.questions), "found")

    # -- two slices of each dataset, for incremental work -----------------------
    def slice(self, second: bool) -> DataFrame:
        """First or second half of every dataset by id."""
        half = self.events.groupBy("dataset").agg(F.floor(F.max("id") / 2).alias("_half"))
        df = self.events.join(cut(half, "half"), "dataset")
        test = F.col("id") > F.col("_half") if second else F.col("id") <= F.col("_half")
        return df.filter(test).drop("_half")

    @cached_property
    def first_slice(self) -> C.Correlation:
        return C.correlate(cut(SC.score_core(self.slice(False)), "scored-1"))

    @cached_property
    def second_slice(self) -> C.Correlation:
        return C.correlate(cut(SC.score_core(self.slice(True)), "scored-2"))

    @cached_property
    def merged(self) -> DataFrame:
        return cut(I.merge_incidents(self.first_slice.members, self.second_slice.members), "merged")
