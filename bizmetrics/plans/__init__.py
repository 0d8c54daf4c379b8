"""Whole questions, composed from operators: boards, lists, reports."""
