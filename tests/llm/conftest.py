import datetime

import pytest
from pyspark.sql import functions as F

T0 = datetime.datetime(2025, 3, 1)
NOISE = [("extra", "int"), ("rep", "string"), ("key", "string")]


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Write small tables of the schemas that the queries read; extra columns have clashing names."""
    schemas = {
        "qa_records": "record_id long, source string, split string, query string, response string, query_norm string, ingested_at timestamp",
        "chat_samples": "sample_id long, split string, source string, conversations array<struct<`from`:string,value:string>>",
        "api_requests": "req_no long, text string",
        "raw_records": "line_id long, payload string, received_at timestamp",
        "test_results": "item_id long, prompt string, reference string, generated string",
        "rl_samples": "row_id long, question string, answer string",
        "prompt_messages": "item_id long, split string, messages array<struct<role:string,content:string>>",
        "documents": "doc_id long, text string, n_chars long",
        "token_limits": "limit_id long, capacity int, overlap int",
    }

    def make(**rows):
        d = tmp_path_factory.mktemp("tables")
        for name, schema in schemas.items():
            df = spark.createDataFrame(rows.get(name, []), schema)
            for c, t in NOISE:
                df = df.withColumn(c, F.lit(None).cast(t))
            df.repartition(3).write.parquet(str(d / f"{name}.parquet"))
        return str(d)

    return make


@pytest.fixture
def t0():
    return T0
