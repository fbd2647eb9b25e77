"""marlstone.streaming"""
