"""Readers and writers of pair tables, score runs, judgments, task XML, LTR lines and submissions."""
