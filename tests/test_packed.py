from hypothesis import given, settings, strategies as st

from mosaiq.operators.packed import best_cover, known_values, segment, split_packed


def test_separators_and_normal_form():
    assert segment("a  B,c;;d|e、f\tg\xa0h　i") == list("abcdefghi")
    assert segment(None or "") == [] and segment(" \n ") == []
    assert segment("ｓｏｌｏ＿ｘ") == ["solo_x"]
    assert segment("naïve nai\u0308ve") == ["naïve", "naïve"]


def test_quotes():
    assert segment('"a  b" c') == ["a_b", "c"]
    assert segment('"left|right, x"') == ["left|right,_x"]
    assert segment('"a ""quiet"" day"') == ['a_"quiet"_day']
    assert segment(r'["a_\"quiet\"_day", "smile"]') == ['a_"quiet"_day', "smile"]
    assert segment('"" , " " x') == ["x"]
    assert segment('"never closed x') == ['"never', "closed", "x"]
    assert segment('5"disk "a b"') == ['5"disk', "a_b"]


def test_brackets_only_around_the_whole_field():
    assert segment('["a", "b c"]') == ["a", "b_c"]
    assert segment("[]") == [] and segment("[x] y") == ["[x]", "y"]


def test_known_values_protect_delimiters():
    assert segment("a left|right b", ("left|right",)) == ["a", "left|right", "b"]
    assert segment("a left|righty b", ("left|right",)) == ["a", "left", "righty", "b"]
    # the cheaper cover is taken, not the first match
    assert segment("x,y,z", ("x,y", "y,z", "x,y,z")) == ["x,y,z"]
    assert best_cover("", {}) == []


words = st.lists(st.text('ab",;|、 \\[]\n', max_size=8), max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(words)
def test_dictionary_of_quoted_forms_never_changes_the_result(field):
    assert segment(field, ('"a b"', '"a"', '"b,a"', '"a""b"')) == segment(field)


def test_rows(spark):
    df = spark.createDataFrame([(1, 'b "c d" b', "x"), (2, None, "y"), (3, "", None), (None, "q", "z"), (4, "long " * 20_000, "w"), (1, 'b "c d" b', "x")], "row_id long, tags string, term string")
    got = [(r.row_id, r.pos, r.term) for r in split_packed(df.where("row_id is null or row_id < 4"), "tags", ["row_id"]).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1, "b"), (1, 2, "c_d"), (1, 3, "b")] * 2 + [(None, 1, "q")], key=repr)
    assert split_packed(df.where("row_id = 4"), "tags", ["row_id"]).count() == 20_000
    assert split_packed(df.limit(0), "tags", ["row_id"]).count() == 0
    assert known_values(df, "tags") == ('"c d"',)


def test_a_dictionary_changes_rows_where_nothing_else_protects(spark):
    """Values known from elsewhere are kept whole though they stand unquoted; without them they fall apart."""
    df = spark.createDataFrame([(1, "red, new york |blue"), (2, 'new york,"a b"'), (3, None)], "row_id long, tags string")
    rows = lambda known: {(r.row_id, r.pos, r.term) for r in split_packed(df, "tags", ["row_id"], known).collect()}
    assert rows(("new york",)) == {(1, 1, "red"), (1, 2, "new_york"), (1, 3, "blue"), (2, 1, "new_york"), (2, 2, "a_b")}
    assert rows(()) == {(1, 1, "red"), (1, 2, "new"), (1, 3, "york"), (1, 4, "blue"), (2, 1, "new"), (2, 2, "york"), (2, 3, "a_b")}
