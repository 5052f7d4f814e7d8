"""Every job of the command line on small files."""

import json

from orebed import cli


def test_jobs(spark, tmp_path, capsys):
    p = {k: str(tmp_path / k) for k in ("r.json", "b.json", "ub.csv", "train.csv", "test.csv")}
    out = lambda n: str(tmp_path / f"out{n}")
    with open(p["r.json"], "w") as f:
        for i in range(12):
            f.write(json.dumps({"date": f"201{7 + i % 2}-01-01", "user_id": f"u{i % 4}", "business_id": f"b{i % 3}", "stars": i % 5}) + "\n")
    with open(p["b.json"], "w") as f:
        for i in range(3):
            f.write(json.dumps({"business_id": f"b{i}", "city": f"c{i % 2}"}) + "\n")
    with open(p["ub.csv"], "w") as f:
        f.write("user_id,business_id\n" + "".join(f"u{u},b{b}\n" for u in range(6) for b in range(5) if (u + b) % 4))
    for k in ("train.csv", "test.csv"):
        with open(p[k], "w") as f:
            f.write("user_id,business_id,stars\n" + "".join(f"u{u},b{b},{1 + (u * b) % 5}\n" for u in range(6) for b in range(5) if (u + b) % 4))
    cli.main(["stats", p["r.json"], out(1)], spark)
    report = json.load(open(out(1)))
    assert report["n_review"] == 12 and report["n_review_2018"] == 6 and report["top10_business"][0] == ["b0", 4]
    cli.main(["partitions", p["r.json"], out(2), "2"], spark)
    assert sum(json.load(open(out(2)))["customized"]["n_items"]) == 12
    cli.main(["cities", p["r.json"], p["b.json"], out(3), out(4)], spark)
    assert "m1" in json.load(open(out(4)))
    cli.main(["itemsets", "1", "3", p["ub.csv"], out(5)], spark)
    assert open(out(5)).read().startswith("Candidates:\n('b0')")
    cli.main(["large-itemsets", "2", "3", p["ub.csv"], out(6)], spark)
    city = [r[0] for r in spark.read.text(out(3)).collect()]
    assert city[0] == "city,stars" and sorted(x.split(",")[0] for x in city[1:]) == ["c0", "c1"]
    with open(tmp_path / "truth.csv", "w") as f:
        f.write("business_id_1,business_id_2\nb1,b0\n")
    cli.main(["similar", p["ub.csv"], out(7), "--truth", str(tmp_path / "truth.csv")], spark)
    assert "'fn':" in capsys.readouterr().out
    pairs = open(out(7)).read().splitlines()
    assert pairs[0] == "business_id_1, business_id_2, similarity" and pairs[1:] == sorted(pairs[1:]) and all(float(x.split(",")[2]) >= 0.5 for x in pairs[1:])
    cli.main(["predict", p["train.csv"], p["test.csv"], "3", out(8), "--shuffle-partitions", "2"], spark)
    rows = open(out(8)).read().splitlines()
    assert rows[0] == "user_id, business_id, prediction" and len(rows) == len(open(p["test.csv"]).read().splitlines())
    cli.main(["labels", "2", p["ub.csv"], out(9)], spark)
    cli.main(["communities", "2", p["ub.csv"], out(10), out(11)], spark)
    lines = [r[0] for r in spark.read.text(out(11)).collect()]
    assert sorted(x for line in lines for x in line.replace("'", "").split(", ")) == [f"u{i}" for i in range(6)]
