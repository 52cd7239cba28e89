"""Data contracts: rules, dataset checks, invariants, the trust score and its report."""
