from tablewright.llm.queries import op10_line_dedup_whole


def test_lines_of_every_length(spark, tmp_path):
    sixteen, near, other = "abcdefghijklmnop", "abcdefghijklmno", "abcdefghijklmnX"
    docs = [(1, f"short\n\n{near}\n{sixteen}"), (2, f"{other}\n short \n"), (3, "a\nshort\nshorT\na"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op10_line_dedup_whole(spark, str(tmp_path)).collect()))
    # near and other are both under 16 characters, so they meet through sixteen only, each within two edits of it
    assert got == [
        (1, 0, 0, 1, 0, True), (1, 1, 0, 1, 1, True), (1, 2, 1, 1, 2, True), (1, 3, 2, 1, 2, False),
        (2, 0, 1, 1, 2, False), (2, 1, 0, 1, 0, False), (2, 2, 0, 2, 2, True),
        (3, 0, 0, 3, 0, True), (3, 1, 0, 1, 0, False), (3, 2, 0, 3, 2, True), (3, 3, 0, 3, 0, False),
    ]
