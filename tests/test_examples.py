from examples import build_game, compare_all, compare_pair, solve_game


def test_examples(spark, tmp_path):
    found = compare_pair.main(spark)
    assert found["traces"] and not found["bisimulation"]
    assert compare_all.main(spark) == {"enabledness": 5, "traces": 5, "simulation": 6, "bisimulation": 6}
    lines = build_game.main(spark)
    assert "(0, {10})a -> (0, {10}, {})d" in lines and len(lines) > 10
    assert 0 < solve_game.main(spark, str(tmp_path / "game.json"), 30, 4) <= 30
