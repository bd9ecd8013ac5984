"""Operators on DataFrames: entity resolution, fusion, scoring, qualification, upserts, funnels, health."""
