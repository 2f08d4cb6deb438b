from tokenloom.llm import content, graph


def test_content_by_join_equals_content_in_tasks(spark):
    import pyarrow as pa

    pieces = {0: "a", 1: " b", 2: "é"}
    vocabulary = spark.createDataFrame([*pieces.items(), (50256, "<end>")], "token_id int, piece string")
    data = [(1, None, [0, 1, 2, 50256]), (2, "own", [0]), (3, None, None), (4, None, []), (5, None, [9, 0])]
    joined = {r.k: r.text for r in content.joined_content(spark.createDataFrame(data, "k int, text string, ids array<int>"), vocabulary, "k").collect()}
    held = content.vocabulary(vocabulary).value
    made = content.fill_content(pa.array([d[1] for d in data], pa.string()), pa.array([d[2] for d in data], pa.list_(pa.int32())), held).to_pylist()
    assert made == [joined[k] for k in (1, 2, 3, 4, 5)] == ["a bé", "own", None, "", "a"]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (10, 9), (9, 8), (8, 7), (7, 6), (5, 5), (None, 4), (20, 21), (20, 21)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 1 for i in (1, 2, 3)} | {i: 6 for i in range(6, 11)} | {20: 20, 21: 20} | {100 + i: 100 for i in range(30)}
    assert got == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
