"""A table function for SQL users; ``operators.skills.extract`` is the form for DataFrames and stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from postlens.operators.skills import boundary


def register_extract_skills(spark: SparkSession, taxonomy: dict[str, str], name: str = "extract_skills") -> None:
    """Register ``name(text) -> (category, skill)`` over a taxonomy of skill -> category."""

    @udtf(returnType="category string, skill string")
    class ExtractSkills:
        def __init__(self):
            self.known = [(re.compile(boundary(t).replace(r"\p{L}\p{N}", r"\w")), c, t) for t, c in taxonomy.items()]

        def eval(self, text: str):
            low = (text or "").lower()
            for pattern, category, skill in self.known:
                if pattern.search(low):
                    yield category, skill

    spark.udtf.register(name, ExtractSkills)
