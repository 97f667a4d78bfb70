import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from crossblock.session import session

    spark = session(
        "local[8]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def cells(spark):
    """A small valid cell table made by the build itself."""
    from crossblock.plans import build
    from crossblock.session import cut

    return cut(build.build_cells(toy_facts(spark), toy_templates(spark), TOY))


def toy_facts(spark, n=40, families=("capital", "river", "author")):
    rows = [
        (f, f"{f} subject {i}", f"{f} answer {i % 12}") for f in families for i in range(n)
    ]
    return spark.createDataFrame(rows, "relation_family string, subject string, answer string")


def toy_templates(spark, families=("capital", "river", "author")):
    rows = [
        (f, i, f"{f}/t{i + 1}", t)
        for f in families
        for i, t in enumerate(["What of {s}?", "Say what {s} has.", "Name it: {s}"])
    ]
    return spark.createDataFrame(
        rows, "relation_family string, ordinal int, template_id string, text string"
    )


def _toy():
    from crossblock.plans.build import BuildConfig

    return BuildConfig(holdout=("author",), pairings_per_fact=2, templates_per_family=3, seed=3)


TOY = _toy()
