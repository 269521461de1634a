"""Event-file reader on hand-made lines; rating files."""

import datetime as dt

from relflow.sources.events import event_columns, read_events
from relflow.sources.ratings import read_ratings


def _line(**over):
    vals = {n: "" for n, _ in event_columns()}
    vals.update({"globalEventID": "1", "day": "20170328", "quadClass": "1", "isRoot": "1",
                 "actor1Code_countryCode": "USA", "actor2Code_countryCode": "FRA", "goldstein": "1.5",
                 "dateAdded": "20170329", "sourceUrl": "http://x"})
    vals.update(over)
    return "\t".join(vals[n] for n, _ in event_columns())


def test_event_lines(spark, tmpdir_run):
    full = _line()
    lines = [
        full,
        _line(globalEventID="2") + "\r",             # CRLF ending
        _line(globalEventID="3", sourceUrl=""),       # empty last field
        "\t".join(full.split("\t")[:17]).replace("1\t", "4\t", 1),  # row cut inside a group
        _line(globalEventID="5") + "\textra",         # 59 tokens
        "",                                            # blank line
        _line(globalEventID="x7"),                    # non-numeric int
        _line(globalEventID="8", actor1Geo_featureId="abc"),
        _line(globalEventID="9", day="20170230"),     # impossible date
        _line(globalEventID="10", day="201703281230"),
        _line(globalEventID="11", day=""),
        _line(globalEventID="12", actor2Code_countryCode=""),
        _line(globalEventID="13", quadClass=""),
        _line(globalEventID="14", actor1Code_name='A "quoted" name'),
        _line(globalEventID="15", isRoot="0"),
    ]
    p = f"{tmpdir_run}/events.tsv"
    with open(p, "w", newline="") as f:
        f.write("\n".join(lines) + "\n")
    df = read_events(spark, p)
    assert len(df.columns) == 58
    rows = df.collect()
    assert len(rows) == 14                          # blank line skipped
    by = {r.globalEventID: r for r in rows if r.globalEventID is not None}
    assert by[1].day == dt.date(2017, 3, 28) and by[1].isRoot is True and by[1].goldstein == 1.5
    assert by[2].sourceUrl == "http://x"            # no trailing \r
    assert by[3].sourceUrl is None
    assert by[4].dateAdded is None and by[4].actor2Code_countryCode is None
    assert by[5].sourceUrl == "http://x"
    assert any(r.globalEventID is None and r.actor1Code_countryCode == "USA" for r in rows)
    assert by[8].actor1Geo_featureId is None and by[8].quadClass == 1
    assert by[9].day is None and by[10].day is None and by[11].day is None
    assert by[12].actor2Code_countryCode is None and by[13].quadClass is None
    assert by[14].actor1Code_name == 'A "quoted" name'
    assert by[15].isRoot is False


def test_ratings_layouts(spark, tmpdir_run):
    p = f"{tmpdir_run}/r.csv"
    with open(p, "w") as f:
        f.write("1490000000,3,7\n1490000100,4,8\n")
    r = read_ratings(spark, p, "rating").collect()
    assert [(x.user_id, x.item_id, x.rating) for x in r] == [(3, 7, 1.0), (4, 8, 1.0)]
    e = read_ratings(spark, p, "evaluation").collect()
    assert [(x.ts, x.user_id, x.item_id) for x in e] == [(1490000000, 3, 7), (1490000100, 4, 8)]
    assert len({x.evaluation_id for x in e}) == 2
