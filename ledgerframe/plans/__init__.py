"""Logical plans: cleaning datasets, golden record, reports, measures, pages."""
