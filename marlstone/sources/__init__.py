"""marlstone.sources"""
