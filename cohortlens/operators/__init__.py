"""Operators: voxel preparation, image filters, feature families, frames, scoring, learners, evaluation."""
