"""Words beside the broadcast table: the table is only asked, never gone through or copied for a text."""

from delspan.llm import collocations


class Table(dict):
    def _whole(self, *_):
        raise AssertionError("the whole table was gone through")

    keys = items = values = __iter__ = __or__ = __ror__ = copy = _whole

    def __reduce__(self):
        return Table._of, (list(dict.items(self)),)

    @staticmethod
    def _of(items):
        table = Table()
        for k, v in items:
            table[k] = v
        return table


def test_words_beside_the_table(spark):
    shared = spark.sparkContext.broadcast({"en": Table._of([(b"", -1), (b"\n", 0), (b"one", 1)])})
    docs = spark.createDataFrame([("en", "One two, three two."), ("en", "one"), ("de", "one zwei"), ("en", None)], "lang string, text string")
    vocabulary = spark.createDataFrame([(1, "en", "one"), (2, "en", "two"), (3, "en", "three"), (4, "de", "zwei")], "id long, lang string, word string")
    top = spark.createDataFrame([(1,)], "id long")
    found = collocations.with_other_numbers(docs, vocabulary, top, shared).collect()
    got = {(r.lang, r.text): sorted(tuple(x) for x in r.more or []) for r in found}
    assert got == {("en", "One two, three two."): [("three", 3), ("two", 2)], ("en", "one"): [], ("de", "one zwei"): [("zwei", 4)], ("en", None): []}
