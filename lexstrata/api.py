"""The read contract over a data directory: search, resolve_as_of, hsk_requirements, expand_article."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.functions.temporal import as_day, in_force
from lexstrata.operators import refgraph, requirements
from lexstrata.operators import search as retrieval
from lexstrata.plans import views
from lexstrata.session import scratch_path, written


@dataclass
class Repository:
    """All read functions over the tables of one directory; every one returns a lazy DataFrame.

    index: folder of the stored vectors (store_vectors); None: they are encoded and written once, at the first dense search.
    """

    spark: SparkSession
    path: str
    index: str | None = None

    def store_vectors(self, index: str) -> None:
        """Encode the texts of all current versions and write (id, embedding)."""
        current = views.versions(self.spark, self.path).where("is_current").select("id", "loaded_at")
        texts = views.texts(self.spark, self.path).join(current, ["id", "loaded_at"], "left_semi").dropDuplicates(["id"])
        retrieval.hashed_encoder(texts, "content").select("id", "embedding").write.mode("overwrite").parquet(index)
        self.index = index

    def search(self, query: str, arm: str = "dense", limit: int = 10, as_of: dt.date | str | None = None) -> DataFrame:
        """(article_pk, score, text); as_of None: current versions."""
        vectors = vector = None
        if arm == "dense":
            if self.index is None:
                self.store_vectors(scratch_path(self.spark, "vectors"))
            vectors = self.spark.read.parquet(self.index)
            vector = retrieval.hashed_model()([query])[0].tolist()
        day = as_day(as_of) if as_of else None
        versions = written(views.versions(self.spark, self.path, *retrieval.LEDGER), "versions")
        return retrieval.search(versions, query, arm, limit, day, vectors, vector, views.texts(self.spark, self.path))

    def resolve_as_of(self, law_id: str, article_no: int, paragraph_no: int | None = None, as_of: dt.date | str | None = None) -> DataFrame:
        """The version in force on a day: one row or none."""
        rows = views.history_rows(self.spark, self.path)
        return rows.where((F.col("law_id") == law_id) & (F.col("article_no") == article_no) & F.col("paragraph_no").eqNullSafe(F.lit(paragraph_no).cast("int")) & in_force(as_day(as_of))).limit(1)

    def hsk_requirements(self, code: str | None, trade_type: str | None = None, as_of: dt.date | str | None = None) -> DataFrame:
        """One nested row: names, ancestors, direct and inherited requirements."""
        asked = self.spark.createDataFrame([(code,)], "code string")
        day = dt.date.fromisoformat(as_of) if isinstance(as_of, str) and as_of else as_of or dt.date.today()
        found = requirements.lookup(asked, views.requirement_paths(self.spark, self.path), trade_type, day.strftime("%Y%m%d"))
        return requirements.lookup_response(asked, views.catalogue(self.spark, self.path), found)

    def expand_article(self, article_pk: int) -> DataFrame:
        """One hop out of an article of the citation graph; no rows for an unknown one."""
        nodes, _, edges = views.citation_graph(self.spark, self.path)
        return refgraph.expand(self.spark.createDataFrame([(article_pk,)], "article_pk long"), edges, nodes)
