"""Operators over tables of elements, tables and chunks."""
