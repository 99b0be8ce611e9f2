from murmurlake.operators import jobs


def test_sorting_and_assignees(spark):
    schema = "job_id long, idx int, project string, done boolean, assignee string, due string, updated_at string"
    rows = [(1, 0, "Öst", False, " Åsa ", "2024-02-01", "b"), (2, 0, "Alfa", True, "Zed", "2024-01-01", "c"), (3, 0, "Älv", False, "", "snart", None), (4, 0, "Åre", False, None, "2024-01-05", "a")]
    df = spark.createDataFrame(rows, schema)
    order = lambda by: [r.job_id for r in jobs.sorted_actions(df, by).collect()]
    assert order("due") == [4, 1, 3, 2] and order("project") == [2, 4, 3, 1] and order("updated") == [2, 1, 4, 3]
    assert [r.assignee for r in jobs.assignees(df).collect()] == ["Zed", "Åsa"]


def test_folders(spark):
    folders = spark.createDataFrame([("a",), ("a/b",), ("a/b/c",), ("d",)], "folder string")
    tree = jobs.folder_tree(folders)
    assert {(r.folder, r.has_children) for r in tree.collect()} == {("a", True), ("a/b", True), ("a/b/c", False), ("d", False)}
    assert {r.folder for r in jobs.visible_folders(tree, ["a"]).collect()} == {"a", "a/b", "d"}
    assert jobs.unique_name({"Ny mapp", "Ny mapp 2"}) == "Ny mapp 3"


def test_finished_meetings(spark):
    done = spark.createDataFrame([(1, "t1", None), (2, "t2", "new"), (3, "t3", None)], "id long, transcript string, audio_path string")
    work = "id long, transcript string, audio_path string, title string, notes string"
    stored = spark.createDataFrame([(1, "x", "old", "A", "")], work)
    snaps = spark.createDataFrame([(1, "y", "z", "B", "kept?"), (2, "y", "z", "C", "n")], work)
    got = {r.id: (r.transcript, r.audio_path, r.title, r.notes) for r in jobs.finished_meetings(done, stored, snaps).collect()}
    assert got == {1: ("t1", "old", "A", ""), 2: ("t2", "new", "C", "n")}
