"""Where queries and their SQL counterparts are registered."""

from functools import wraps

from pyspark.sql import functions as F

from ..driver_sql import compose
from ..driver_tables import DriverTables

QUERIES: dict = {}
ORACLES: dict = {}


def query(key: str, sql: str | None = None):
    def register(build):
        @wraps(build)
        def run(spark, sf_dir):
            return build(DriverTables(spark, sf_dir))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = compose(sql)
        return build

    return register


def rounded(df, *columns, digits: int = 4):
    """Sums and means of doubles depend on the order of addition; compare them to 4 places."""
    for name in columns:
        df = df.withColumn(name, F.round(name, digits))
    return df
