"""A catalogue of tables that are rewritten within a session."""

from __future__ import annotations

from granary.plans import catalog


def test_a_rewritten_folder_is_projected_anew(spark, tmp_path):
    def write(n):
        rows = [(i, f"text {i} of {n}", "en", "src1", 10) for i in range(n)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")

    spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for n in (3, 5):
        write(n)
        first, again = (catalog.from_documents(spark, str(tmp_path)) for _ in range(2))
        assert first.file.count() == n and first.asset.count() == n
        assert again._base is first._base
