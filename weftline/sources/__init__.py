"""Readers for the workspace tables and writers for reports."""
