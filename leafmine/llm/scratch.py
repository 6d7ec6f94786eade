"""Intermediate tables of the corpus operators: those of leafmine.scratch, and a way to drop them early."""

import gc

from leafmine import scratch


class Scratch(scratch.Scratch):
    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads. Shuffle files of steps that are over go, too: Spark deletes
        them when the driver's collector finds that nothing refers to them."""
        gc.collect()
        self.spark._jvm.System.gc()
        for name in names:
            scratch.delete(self.spark, f"{self.root}/{name}")
