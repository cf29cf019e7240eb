"""The ledger, both ways of running stages, and settings."""

from dataclasses import dataclass

import pytest

from lectern.plans import runner
from lectern.plans.settings import load


def made(spark, names, log, fail=(), settings=None):
    files = runner.Files(spark)

    def stage(name):
        def work(place):
            log.append(name)
            if name in fail:
                raise RuntimeError(f"{name} broke")
            if not files.exists(f"{place.folder}/out"):
                files.create(f"{place.folder}/out", name)
            return name.upper()

        return runner.Stage(name, work, {"p": 1, **(settings or {}).get(name, {})}, [f"{name}/out"])

    return [stage(n) for n in names]


def test_settled_stages_are_skipped_and_changes_run_on(spark, tmp_path):
    ledger, log = runner.Ledger(spark, str(tmp_path), "r"), []
    assert runner.run_in_order(made(spark, "abc", log), ledger) == {"a": "A", "b": "B", "c": "C"}
    assert runner.run_in_order(made(spark, "abc", log), runner.Ledger(spark, str(tmp_path), "r")) == {} and log == list("abc")
    (tmp_path / "r/b/out").unlink()
    assert list(runner.run_in_order(made(spark, "abc", log), ledger)) == ["b", "c"]
    assert list(runner.run_in_order(made(spark, "abc", log, settings={"b": {"q": [1, 2]}}), ledger)) == ["b", "c"]
    assert runner.run_in_order(made(spark, "abc", log, settings={"b": {"q": [1, 2]}}), ledger) == {}


def test_a_stop_between_two_stages_is_noticed(spark, tmp_path):
    """The second stage was changed and fails, then the first settings come back: the third ran on other input and runs again."""
    ledger, log = runner.Ledger(spark, str(tmp_path), "r"), []
    runner.run_in_order(made(spark, "abc", log), ledger)
    with pytest.raises(RuntimeError):
        runner.run_in_order(made(spark, "abc", log, fail="c", settings={"b": {"q": 1}}), ledger)
    known = ledger.known()
    assert known["c"].status == "failed" and "c broke" in known["c"].error and known["c"].outputs == ("c/out",) and known["b"].status == "done"
    assert list(runner.run_in_order(made(spark, "abc", log), ledger)) == ["b", "c"]
    assert ledger.known()["c"].error is None


def test_a_policy_picks_and_no_stage_is_forced(spark, tmp_path):
    ledger = runner.Ledger(spark, str(tmp_path), "p")
    assert list(runner.run_by_policy(made(spark, "abc", []), ledger)) == list("abc")
    assert list(runner.run_by_policy(made(spark, "abc", [], settings={"b": {"q": 1}}), ledger)) == ["b"]
    with pytest.raises(RuntimeError, match="end"):
        runner.run_by_policy(made(spark, "ab", []), runner.Ledger(spark, str(tmp_path), "q"), lambda view: "a", 3)


def test_keys_depend_on_values_not_on_order():
    key = runner.settings_key
    assert key({"a": 1, "b": {"c": [1, "x"]}}) == key({"b": {"c": (1, "x")}, "a": 1})
    keys = {key(x) for x in ({}, {"a": 1}, {"a": "1"}, {"a": [1]}, {"a": {"0": 1}}, {"a": None}, {"a": []}, {"a": {}})}
    assert len(keys) == 8 and key({}, "x") != key({})


def test_ledgers_live_on_any_file_system(spark, tmp_path):
    ledger = runner.Ledger(spark, f"file://{tmp_path}", "r")
    assert list(runner.run_in_order(made(spark, "a", []), ledger)) == ["a"] and (tmp_path / "r/_ledger/00000001.json").exists()


@dataclass(frozen=True)
class Own:
    size: int = 3
    rate: float = 0.5
    on: bool = False
    name: str | None = None


def test_settings_from_file_and_environment(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text('size = 5\nrate = 1\n[other]\nx = 1\n')
    assert load(Own, str(path), "T", {"T_ON": "yes", "T_SIZE": "7", "T_NAME": "n", "U_SIZE": "9"}) == Own(7, 1.0, True, "n")
    assert load(Own, None, "T", {}) == Own()
    for text, env in (("sizes = 1", {}), ('size = "x"', {}), ("size = true", {}), ("", {"T_ON": "perhaps"}), ("rate = [1]", {})):
        path.write_text(text)
        with pytest.raises(ValueError):
            load(Own, str(path), "T", env)
