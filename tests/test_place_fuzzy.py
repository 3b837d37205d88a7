"""Misspelt places over the whole lexicon."""

from watchgrid.operators import records


def test_nearest_spelling_first_then_region(spark):
    places = [(1, "abcdefgh", 1, "town", 10), (2, "abcdefxy", 2, "town", 10), (3, "kolomyya", 1, "hamlet", 9), (4, "kolomyya", 1, "city", 1), (5, "kolomyia", 1, "town", 5), (6, "shortx", 1, "town", 5), (7, "зарас", 1, "town", 5)]
    mentions = [
        (1, "abcdefgx", 1),  # one edit from both
        (2, "abcdefg", 2),  # nearest spelling is in region 1
        (3, "kolomyyaa", 1),  # two places of the name, by rank not id
        (4, "kolomyya", 1),  # its own spelling
        (5, "abcdefxyzz", 2),  # two edits
        (6, "shorxt", 1),  # two edits below 8 letters
        (7, "зараз", 1),  # stopword
        (8, "abcdefgx", None),
        (9, "abcdefgh", 2),  # spelt as elsewhere
    ]
    p = spark.createDataFrame(places, "place_id long, name string, region long, place string, population long")
    m = spark.createDataFrame(mentions, "mention_id long, mention string, region long")
    got = lambda **k: sorted(tuple(x) for x in records.place_fuzzy(m, p, **k).collect())
    one = [(1, 1, 1, 0.7), (3, 1, 4, 0.56)]
    assert got() == one
    assert got(most=2) == [*one, (5, 2, 2, 0.55)]
    assert got(stopwords=("abcdefgx",)) == [(3, 1, 4, 0.56), (7, 1, 7, 0.7)]
