"""Readers for history text, source trees and the parquet tables."""
