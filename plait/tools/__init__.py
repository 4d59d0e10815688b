"""Tools over graphs, trees and alignments."""
