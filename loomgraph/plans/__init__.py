"""Plan helpers: cutting lineage, fixpoint loops, running sums without a global window."""
