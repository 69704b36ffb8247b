from wardlight.llm.files import locate, qualified


def test_bare_paths_lie_in_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert qualified(spark, "/a/b c").replace("%20", " ") == "file:/a/b c"
    assert locate(qualified(spark, "/a/b c"))[1] == "/a/b c"
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "viewfs://cluster/")
        conf.set("fs.viewfs.mounttable.cluster.link./user", "file:/tmp")
        assert qualified(spark, "/user/x") == "viewfs://cluster/user/x"
        assert qualified(spark, "file:/user/x") == "file:/user/x"
    finally:
        conf.set("fs.defaultFS", before)
