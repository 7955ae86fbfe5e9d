import pytest

SCHEMAS = {
    # Columns beyond the given ones, with names that the operators use themselves.
    "documents": "doc_id long, text string, lang string, source string, n_chars long, shard int, fp long, "
                 "size long, keep boolean, tokens long, place long, item_id long, n_windows long",
    "pages": "page_id long, url string, html string, payload string, kept long, warc_type string",
    "benchmark": "item_id long, text string, pos long, hash long, doc_id long",
    "labels": "doc_id long, quality int, toxic int, text string, keep boolean",
}


@pytest.fixture
def tables(spark, tmp_path):
    """Write small tables; rows may leave out trailing columns.  Gives the folder."""

    def write(**rows):
        for name, schema in SCHEMAS.items():
            width = schema.count(",") + 1
            data = [(*r, *[None] * (width - len(r))) for r in rows.get(name, [])]
            spark.createDataFrame(data, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
