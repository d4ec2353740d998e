"""A procurement cycle that is cut off after every step in turn ends with the tables of an undisturbed one."""

import pytest

from harvestline.checks.registry import Tables
from harvestline.checks.workflow import cycle_tables
from harvestline.plans import workflow
from harvestline.plans.steps import StepLog
from harvestline.session import scratch_path
from harvestline.sources.bindings import AS_OF_EVENTS

FOLDER = "/root/testdata/sf0.001"
STEPS = ["email_outbox", "email_inbox", "new_drafts", "budget_ledger", "po_drafts", "invoice_reconciliations",
         "supplier_applications"]


class Cut(Exception):
    pass


class CutLog(StepLog):
    """Stops after each new step; every second time a table without marker is left behind first."""

    built: list[str] = []
    torn: set[str] = set()

    def once(self, step, build):
        if step in self.committed():
            return super().once(step, lambda: pytest.fail(f"{step} is done twice"))
        if len(self.built) % 2 and step not in self.torn:
            self.torn.add(step)
            self.spark.range(3).write.mode("overwrite").parquet(f"{self.path}/{step}")
            raise Cut
        super().once(step, build)
        self.built.append(step)
        raise Cut


def test_a_cut_cycle_resumes_without_doing_a_step_twice(spark):
    tables = cycle_tables(Tables(spark, FOLDER))
    log = CutLog(spark, scratch_path(spark, "cycles"), "2024-01")
    for _ in range(2 * len(STEPS)):
        try:
            resumed = workflow.p2p_cycle(tables, AS_OF_EVENTS, steps=log)
            break
        except Cut:
            continue
    assert log.built == STEPS and log.committed() == set(STEPS) and log.torn
    whole = workflow.p2p_cycle(tables, AS_OF_EVENTS)
    assert set(resumed) == set(whole)
    for name, want in whole.items():
        got = resumed[name].select(*want.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0, name
    log.forget()
    assert log.committed() == set()


def test_runs_are_apart_and_names_are_checked(spark):
    folder = scratch_path(spark, "runs")
    a, b = StepLog(spark, folder, "a"), StepLog(spark, folder, "b")
    assert a.once("s", lambda: spark.range(2)).count() == 2
    assert a.once("s", lambda: pytest.fail("built twice")).count() == 2
    assert b.committed() == set() and b.once("s", lambda: spark.range(0)).count() == 0
    for bad in ("", "x/y", ".."):
        with pytest.raises(ValueError):
            StepLog(spark, folder, bad)
